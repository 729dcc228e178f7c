"""Operator 2: edit-aware token counts.

A document keeps a segment tree over its text: the leaves are stretches of about
LEAF characters that end where a pre-token must end (before a space that a letter
follows and no white space precedes), so token counts of leaves add up.  Inner nodes
hold the characters and tokens of what is below them.  An edit (position, characters
removed, text put in) descends to the leaves it touches, re-encodes only these
and one leaf of context on either side, and updates the sums above them.

The vocabulary is a file of byte-pair ranks; its path is a parameter, and the file
must be where the tasks run.

Defined cases: a null text is empty and has no tokens; an edit beyond the end counts
at the end; edits apply in order, each to the text that the former left; a text
without a boundary is one leaf; repeated rows give repeated results; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")
EDITS = "array<struct<pos:bigint,removed:bigint,added:string>>"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary file, once for each process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Stretches of leaf characters or more that end at a boundary; the last may be shorter."""
    out, at = [], 0
    while len(text) - at > leaf:
        m = _CUT.search(text, at + leaf)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


class SegmentTree:
    """Sums of characters and tokens over the leaves of one text, as an implicit binary tree."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        self.count, self.leaf = count, leaf
        self.encoded = 0  # characters encoded so far
        self._build([(x, self._tokens(x)) for x in cut(text, leaf)])

    def _tokens(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (x, n) in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = len(x), n
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(x for x, _ in self.leaves)

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a position, and where in it."""
        node = 1
        while node < self.width:
            node *= 2
            if pos >= self.chars[node] and node + 1 < 2 * self.width and self.chars[node + 1]:
                pos -= self.chars[node]
                node += 1
        return node - self.width, pos

    def edit(self, pos: int, removed: int, added: str) -> None:
        if not self.leaves:
            self._build([(x, self._tokens(x)) for x in cut(added, self.leaf)])
            return
        pos = max(0, min(pos, self.n_chars))
        end = min(self.n_chars, pos + max(0, removed))
        i, inner = self.find(pos)
        j, _ = self.find(end)
        lo, hi = max(0, i - 1), min(len(self.leaves) - 1, j + 1)
        before = sum(len(x) for x, _ in self.leaves[lo:i]) + inner
        old = "".join(x for x, _ in self.leaves[lo : hi + 1])
        new = [(x, self._tokens(x)) for x in cut(old[:before] + added + old[before + end - pos :], self.leaf)]
        if len(new) == hi - lo + 1:  # only the paths above these leaves change
            self.leaves[lo : hi + 1] = new
            touched = set()
            for k, (x, n) in enumerate(new, lo):
                self.chars[self.width + k], self.tokens[self.width + k] = len(x), n
                touched.add((self.width + k) // 2)
            while touched:
                for node in touched:
                    if node:
                        self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]
                touched = {x // 2 for x in touched if x > 1}
        else:  # the number of leaves changed: counts are kept, sums are laid out again
            self._build(self.leaves[:lo] + new + self.leaves[hi + 1 :])


def count_with_edits(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars, n_leaves) for every row of docs (doc_id, text): counts before and after the edits, a column of type EDITS, and the characters that the edits made the encoder read."""
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars", "n_leaves"]

    def run(batches):
        enc = encoder(vocabulary)

        def count(text: str) -> int:
            return len(enc.encode_ordinary(text))

        for b in batches:
            rows = []
            for i, text, todo in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("edits").to_pylist()):
                tree = SegmentTree(text.as_py() or "", count, leaf)
                first, tree.encoded = (tree.n_chars, tree.n_tokens), 0
                for e in todo or ():
                    tree.edit(e["pos"] or 0, e["removed"] or 0, e["added"] or "")
                rows.append((i, *first, tree.n_chars, tree.n_tokens, tree.encoded, len(tree.leaves)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names)

    text_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(EDITS).alias("edits"))
    return src.mapInArrow(tidy(run), ", ".join(f"{x} bigint" for x in names))


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits that follow from a row's id and length: a word put in, a stretch removed, a stretch replaced."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    h = F.xxhash64(doc_id)
    at = lambda k: F.pmod(F.xxhash64(h, F.lit(k)), n + 1)
    one = lambda pos, removed, added: F.struct(pos.alias("pos"), F.lit(removed).cast("bigint").alias("removed"), F.lit(added).alias("added"))
    return F.array(one(at(1), 0, " inserted"), one(at(2), 17, ""), one(at(3), 9, "new words\n"))
