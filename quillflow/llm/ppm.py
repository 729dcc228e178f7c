"""Operator 3: language-model scoring by prediction by partial matching.

A text is its words (runs without ASCII white space, A-Z lower-cased) joined by one
space, then an end symbol.  The model is a trie of byte contexts of up to ORDER
bytes, learned from all training texts.  A symbol not seen in a context costs an
escape (method D: each distinct symbol gives half a count to the escape) to the next shorter context,
from whose counts the symbols already refused are excluded; below order 0 the
remaining symbols of 256 are equally likely.  The log10 code lengths of all
symbols add up to a document's score.

Training counts (ORDER + 1)-grams in each task and sums them by key.  All lower orders
follow from these counts.  Since a context's symbols are also symbols of every
shorter context, the mass excluded after an escape is a property of the context
alone; scoring is then a few look-ups a gram.  The trie has no proven size, so it
is dealt into blocks by the last two context bytes (which hold all suffixes of order 2
and more of a context), each of about GRAM_BLOCK grams; a block is broadcast and every text
passes by it once.  The counts of whole words, for the unigram base score, are dealt
into blocks by hash in the same way.  Partial scores are then summed by document.

Defined cases: a null text is empty (one end token); with no training text N = V = 0,
base_score is 0 for each token and the model is uniform; repeated rows all teach and
all get a score; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, text_batches, tidy

ORDER = 5
PAD, END = b"\xfe", b"\xff"  # neither is a byte of UTF-8
GRAM_BLOCK, WORD_BLOCK = 2_000_000, 3_000_000
#: Bytes of text that are scored at once; distinct grams and words that a training task holds before it sends them on.
BATCH, HELD = 1 << 21, 2_000_000
GRAM, WORD = 0, 1
HALF = 0.5


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def gram_keys(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams of tokenised texts, the predicted symbol in the lowest byte, and how many each text has."""
    joined = [b" ".join(t) for t in texts]
    data = np.frombuffer(b"".join(PAD * order + j + END for j in joined), np.uint8)
    keys = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | data[k : k + len(keys)]
    return keys[data[order:] != PAD[0]], np.array([len(j) + 1 for j in joined], np.int64)


def _texts(batches, column: str = "text", size: int = BATCH):
    """Tokenised texts in groups of about size bytes, with their rows: (batch, rows, texts)."""
    for b in batches:
        group, rows, held = [], [], 0
        for i, x in enumerate(b.column(column)):
            x = x.as_py() or b""
            group.append(tokens(x)), rows.append(i)
            held += len(x)
            if held >= size:
                yield b, rows, group
                group, rows, held = [], [], 0
        if group:
            yield b, rows, group


def count_training(texts: DataFrame) -> DataFrame:
    """(kind, key, n): counts of grams and word hashes over texts (text binary)."""

    def send(kind, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def run(batches):
        words: Counter = Counter()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, group in _texts(batches):
            u, n = np.unique(gram_keys(group)[0], return_counts=True)
            both = np.concatenate([keys, u])
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(both[order]) > 0]))
            keys, counts = both[order][first], np.add.reduceat(np.concatenate([counts, n])[order], first)
            for t in group:
                words.update(t)
            words[END] += len(group)
            if len(keys) > HELD:
                yield send(GRAM, keys, counts)
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(words) > HELD // 4:
                yield send(WORD, np.array([*map(word_hash, words)], np.uint64), np.array([*words.values()]))
                words = Counter()
        if len(keys):
            yield send(GRAM, keys, counts)
        if words:
            yield send(WORD, np.array([*map(word_hash, words)], np.uint64), np.array([*words.values()]))

    return texts.mapInArrow(tidy(run), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key, in order of the keys."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class Trie:
    """A block of the context trie.  For each order: grams and their counts, contexts with total, distinct symbols, and the mass that their symbols have in the next shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.levels = []
        for k in range(order + 1):
            source = low if k < 2 else (keys, counts)
            g, n = _grouped(source[0] & np.uint64((1 << 8 * (k + 1)) - 1), source[1])
            ctx = g >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(g) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(g) else np.zeros(0, np.int64)
            distinct = np.diff(np.concatenate([first, [len(g)]]))
            if k and len(g):
                below, m = self.levels[-1][:2]
                mass = np.add.reduceat(m[np.searchsorted(below, g & np.uint64((1 << 8 * k) - 1))], first)
            else:
                mass = np.zeros(len(total), np.int64)
            self.levels.append((g, n.astype(np.float64), ctx[first], total.astype(np.float64), distinct.astype(np.float64), mass.astype(np.float64)))
        self.order = order

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its context."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        mass, distinct = np.zeros(len(grams)), np.zeros(len(grams))  # excluded at the order at hand
        for k in range(self.order, -1, -1):
            g, n, ctx, total, kinds, below = self.levels[k]
            if not len(g) or not len(todo):
                continue
            q = grams[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(ctx, q >> np.uint64(8)), len(ctx) - 1)
            known = ctx[c] == q >> np.uint64(8)
            at = np.minimum(np.searchsorted(g, q), len(g) - 1)
            seen = known & (g[at] == q)
            d = kinds[c] - distinct[todo]
            whole = total[c] - mass[todo]
            out[todo[seen]] += np.log10((n[at[seen]] - HALF) / whole[seen])
            escape = known & ~seen & (d > 0)
            out[todo[escape]] += np.log10(HALF * d[escape] / whole[escape])
            refused = known & ~seen
            mass[todo[refused]], distinct[todo[refused]] = below[c[refused]], kinds[c[refused]]
            todo = todo[~seen]
        out[todo] -= np.log10(np.maximum(1, 256 - distinct[todo]))
        return out


def _score_pass(block: int, trie, group_of, words, totals, n_word_blocks: int):
    """A function that scores batches of texts against one block: sums over the grams and words that belong to it."""
    n, v = totals

    def run(batches):
        t, of, (wk, wn) = trie.value, group_of.value, words.value
        for b, rows, group in _texts(batches):
            keys, sizes = gram_keys(group)
            codes, grams = pd.factorize(keys)
            mine = of[(grams >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)] == block
            value = np.zeros(len(grams))
            own = grams[mine]
            order = np.argsort(own)
            scored = np.zeros(len(own))
            scored[order] = t.log10(own[order])
            value[mine] = scored
            score = np.add.reduceat(value[codes], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            flat = [w for x in group for w in (*x, END)]
            codes, uniq = pd.factorize(np.array(flat, dtype=object))
            h = np.fromiter(map(word_hash, uniq), np.uint64, len(uniq))
            here = h % np.uint64(n_word_blocks) == block
            at = np.minimum(np.searchsorted(wk, h), max(0, len(wk) - 1))
            c = np.where(wk[at] == h, wn[at], 0) if len(wk) else np.zeros(len(h))
            log = np.where(here, np.log10((c + 1) / (n + v + 1)), 0.0)
            lens = np.array([len(x) + 1 for x in group], np.int64)
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            base, known = np.add.reduceat(log[codes], first), np.add.reduceat((here & (c > 0)).astype(np.int64)[codes], first)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(x).take(take) for x in ("doc_id", "_k1", "_k2", "learn")], pa.array(lens), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "_k1", "_k2", "learn", "n_tokens", "n_known", "base_score", "score"])

    return run


def _pack(sizes: list[tuple[int, int]], most: int) -> np.ndarray:
    """Deals groups (id below 65536, size) into blocks of about most; the block of each id, 0 where it has no group."""
    out, held = np.zeros(1 << 16, np.int32), [0]
    for g, n in sorted(sizes, key=lambda x: -x[1]):
        i = next((i for i, x in enumerate(held) if x + n <= most or x == 0), len(held))
        if i == len(held):
            held.append(0)
        held[i] += n
        out[g] = i
    return out


def score(docs: DataFrame, learn: Column, gram_block: int = GRAM_BLOCK, word_block: int = WORD_BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text); learn, a condition on doc_id, names the texts to learn from."""
    spark = docs.sparkSession
    text_batches(spark)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), learn.alias("learn"), F.col("text").cast("binary").alias("text"))
    counts = materialize(count_training(src.where("learn").select("text")), "counts")
    grams, words = counts.where(F.col("kind") == GRAM), counts.where(F.col("kind") == WORD)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    suffix = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    sizes = [(r["g"], r["count"]) for r in grams.groupBy(suffix.alias("g")).count().collect()]  # 65,536 rows at most
    group_of = _pack(sizes, gram_block)
    low = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # as many
    low = (low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy())
    n_words = max(1, -(-v // word_block))
    blocks = max(n_words, int(group_of.max()) + 1)
    of, groups = spark.sparkContext.broadcast(group_of), {b: [int(x) for x in np.flatnonzero(group_of == b)] for b in range(blocks)}
    fields = "doc_id bigint, _k1 bigint, _k2 bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    parts = None
    for block in range(blocks):
        used = {g for g, _ in sizes}
        mine = [g for g in groups[block] if g in used]
        t = (grams if blocks == 1 else grams.where(suffix.isin(mine))).select("key", "n").toArrow()
        trie = Trie(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), low)
        # word hashes are unsigned: their remainder is taken in two steps
        rest = F.pmod(F.pmod(F.shiftrightunsigned("key", 1), F.lit(n_words)) * 2 + F.col("key").bitwiseAND(1), F.lit(n_words))
        w = words.where(rest == block).select("key", "n").toArrow()
        wk = w.column("key").to_numpy().view(np.uint64)
        order = np.argsort(wk)
        table = (wk[order], w.column("n").to_numpy()[order])
        run = _score_pass(block, spark.sparkContext.broadcast(trie), of, spark.sparkContext.broadcast(table), (n, v), n_words)
        del t, w, trie, table
        part = src.mapInArrow(tidy(run), fields)
        part = part if blocks == 1 else materialize(part, f"scores{block}", scan=True)
        parts = part if parts is None else parts.union(part)
    if blocks > 1:
        # rows equal in id and text score alike: they are summed together, divided, and given back as often as they came
        sums = parts.groupBy("doc_id", "_k1", "_k2", "learn").agg(F.count("*").alias("c"), F.max("n_tokens").alias("n_tokens"), *[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")])
        copies = (F.col("c") / blocks).cast("int")
        parts = sums.select("doc_id", "learn", "n_tokens", (F.col("n_known") / copies).cast("bigint").alias("n_known"), (F.col("base_score") / copies).alias("base_score"), (F.col("score") / copies).alias("score"), F.explode(F.sequence(F.lit(1), copies)))
    return parts.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
