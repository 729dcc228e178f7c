"""Operator 7: SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link where they differ in ``THRESHOLD`` = 4 bits or
fewer.  The bits are cut into three blocks (21, 21, 22), so a linked pair
differs in one bit at most in one of them.  A covering code provides the anchors of
a block: the perfect Hamming(15, 11) code (covering radius 1) on its first 15 bits
and the trivial code (radius 0) on the others.  Every fingerprint lives at the
anchor that covers it and is replicated to each anchor within covering radius plus
threshold (2 code bits, or 1 other bit): about 14 anchors a block.  Fingerprints
are compared at each anchor only.

Equal fingerprints are merged first, so exact copies, however many, are one row.
An anchor with many residents (near copies) is split into tiles, each with its
share of the residents, and emits links that keep its members connected rather
than all pairs.

Defined cases: a null or blank text has fingerprint 0, which links as any other; a
null doc_id has a fingerprint and, unless a linked row has an id, a null
component; repeated rows give repeated results; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, shingle_hashes, small, text_batches, tidy
from .components import connected_components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Most residents of one tile of an anchor.
TILE = 4096
#: Most pairs compared at once in a task.
PAIRS = 1 << 21
#: First bit, code bits and plain bits of each block.
BLOCKS = ((0, 15, 6), (21, 15, 6), (42, 15, 7))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()  # both know ASCII only
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle, seed)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, fp bigint) of docs (doc_id, text), from whole texts."""
    text_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "_k1", "_k2", "fp"])

    return src.mapInArrow(tidy(run), "doc_id bigint, _k1 bigint, _k2 bigint, fp bigint")


def hamming_code() -> tuple[np.ndarray, np.ndarray]:
    """home[w]: the codeword of Hamming(15, 11) that covers the 15-bit word w; near[w]: all codewords within 2 bits of w, padded with -1."""
    w = np.arange(1 << 15, dtype=np.int32)
    syndrome = np.zeros_like(w)
    for i in range(15):
        syndrome ^= np.where(w >> i & 1, i + 1, 0).astype(np.int32)
    home = np.where(syndrome > 0, w ^ (1 << np.maximum(syndrome - 1, 0)), w).astype(np.int32)
    flips = np.sort(np.stack([home, *[home[w ^ (1 << i)] for i in range(15)]], axis=1), axis=1)
    flips[:, 1:][flips[:, 1:] == flips[:, :-1]] = -1
    near = -np.sort(-flips, axis=1)[:, : int((flips >= 0).sum(axis=1).max())]
    return home, np.ascontiguousarray(near)


def anchor_rows(fps: np.ndarray, home: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fp, resident) of fingerprints (uint64): each at its home anchor of every block, and at all anchors that a fingerprint within one bit of its block could live at."""
    anchors, owners, resident = [], [], []
    for k, (start, code, plain) in enumerate(BLOCKS):
        c = (fps >> np.uint64(start) & np.uint64((1 << code) - 1)).astype(np.int64)
        p = (fps >> np.uint64(start + code) & np.uint64((1 << plain) - 1)).astype(np.int64)

        def name(c, p, k=k):
            return (k << 32) | (c << 8) | p

        for here, flag in ((name(home[c].astype(np.int64), p), True), *[(name(home[c].astype(np.int64), p ^ (1 << i)), False) for i in range(plain)]):
            anchors.append(here), owners.append(fps), resident.append(np.full(len(fps), flag))
        for j in range(near.shape[1]):
            ok = near[c, j] >= 0
            anchors.append(name(near[c[ok], j].astype(np.int64), p[ok])), owners.append(fps[ok]), resident.append(np.zeros(ok.sum(), bool))
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(resident)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the pairs u, v connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _compare(batches):
    """Over rows sorted by (anchor, tile, residents first): links between residents and visitors of the same anchor and tile."""
    key0, held = None, np.zeros(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("anchor").to_numpy() * 65536 + b.column("tile").to_numpy()
        fp = b.column("fp").to_numpy().view(np.uint64)
        lives = b.column("resident").to_numpy(zero_copy_only=False)
        hk = np.concatenate([np.full(len(held), key0 if len(held) else 0, np.int64), key[lives]])
        hf = np.concatenate([held, fp[lives]])
        gk, gf = key[~lives], fp[~lives]
        # residents are their own visitors too: their pairs share this anchor
        gk, gf = np.concatenate([gk, key[lives]]), np.concatenate([gf, fp[lives]])
        lo, hi = np.searchsorted(hk, gk, "left"), np.searchsorted(hk, gk, "right")
        n = hi - lo
        some = n > 0
        gf, lo, n = gf[some], lo[some], n[some]
        total, at, us, vs = np.cumsum(n), 0, [], []
        while at < len(n):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
            m = n[at:to]
            which = np.repeat(np.arange(at, to), m)
            other = hf[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)]
            mine = gf[which]
            hit = (np.bitwise_count(mine ^ other) <= THRESHOLD) & (mine != other)
            if hit.any():
                x, y = _forest(mine[hit], other[hit])
                us.append(x), vs.append(y)
            at = to
        key0 = int(key[-1])
        held = hf[hk == key0]
        if us:
            x, y = (us[0], vs[0]) if len(us) == 1 else _forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["u", "v"])


def fingerprint_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp), which connect exactly those that the threshold connects."""
    home, near = hamming_code()

    def anchors(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                a, f, r = anchor_rows(fps[at : at + 4096], home, near)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(f.view(np.int64)), pa.array(r)], ["anchor", "fp", "resident"])

    rows = distinct.select("fp").mapInArrow(tidy(anchors), "anchor bigint, fp bigint, resident boolean")
    # residents alone are counted: three rows a fingerprint, summed before the shuffle
    crowded = materialize(rows.where("resident").groupBy("anchor").count().where(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "crowded")
    if crowded.limit(1).count():
        rows = rows.join(small(crowded), "anchor", "left")
        mine = F.array(F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        tiles = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).when(F.col("resident"), mine).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
        # a resident of one tile must meet the residents of the others: it visits them
        visits = F.when(F.col("tiles").isNotNull() & F.col("resident"), F.array_except(F.sequence(F.lit(0), F.col("tiles") - 1), mine)).otherwise(F.array().cast("array<int>"))
        rows = rows.select("anchor", "fp", "resident", F.explode(tiles).alias("tile")).union(rows.select("anchor", "fp", F.lit(False), F.explode(visits)))
    else:
        rows = rows.withColumn("tile", F.lit(0))
    dealt = rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", F.desc("resident"))
    return dealt.mapInArrow(tidy(_compare), "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, fp, component_id) for every row of docs (doc_id, text)."""
    prints = materialize(with_fingerprints(docs), "fingerprints", scan=True)
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(fingerprint_links(least))
    linked = labels.join(least, F.col("node") == F.col("fp"))
    firsts = linked.groupBy("root").agg(F.min("least").alias("component"))
    known = labels.join(firsts, "root").select(F.col("node").alias("_fp"), "component")
    classes = least.join(known, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id"))
    classes = materialize(classes, "classes")  # the last join stands alone, so Spark may split a fingerprint with many copies
    return prints.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "_k1", "_k2", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their component: the smallest doc_id, and of rows equal in doc_id and text one."""
    found = materialize(near_duplicates(docs), "components")
    named = F.col("component_id").isNotNull()
    chosen = found.where(named & (F.col("doc_id") == F.col("component_id"))).groupBy("component_id").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    # components without any doc_id keep one row for each distinct fingerprint
    unnamed = found.where(~named).groupBy("fp").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    keys = chosen.select("k._k1", "k._k2").union(unnamed.select("k._k1", "k._k2")).distinct().hint("shuffle_hash")
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), row_key(F.col("doc_id"), F.col("text")))))
    kept = keyed.join(keys, ["_k1", "_k2"], "left_semi")
    twice = found.join(keys, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").count().where("count > 1")
    if twice.limit(1).count():
        kept = kept.dropDuplicates(["_k1", "_k2"])
    return kept.select(*docs.columns)
