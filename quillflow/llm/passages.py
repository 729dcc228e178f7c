"""Operator 8: substring dedup by compact windows.

A document is a sequence of 5-word shingles.  Under one hash function every
subsequence of MIN_WINDOW shingles or more has a min-hash; the subsequences that
share the position of their minimum form one compact window (left, centre,
right): all that start in left..centre and end in centre..right.  The windows are
the nodes of the Cartesian tree over the hashes whose range is long enough; their
centres are the positions that some sliding window of that length has as minimum,
and left and right end at the nearest smaller centres.

1. Windows of all documents, for N_HASHES functions, are grouped by their
   min-hash.  In each group the first document (smallest doc_id) is the
   reference; the others link to it.
2. Interval join: links of a document and a reference are chained along nearby
   diagonals; a chain needs MIN_HASHES of the functions.
3. Verification: the shingles of both candidate passages are fetched and compared;
   a passage is a repeat if its Jaccard similarity with the reference passage is
   SIMILARITY or more and it has MIN_WORDS words or more.
4. Places of a value that no verified passage covers go on.  A value of FEW
   documents at most links each of them to all earlier ones.  The documents of a
   more frequent value (a common line, say) meet by the place's shingle, each with
   the shingles around it.  A window of MIN_WINDOW shingles that holds the place
   goes on if SIMILARITY of it occurs around the shingle in other documents.  Its
   exact copies link to the first document that holds it; what else may repeat is
   compared with every earlier document that shares SIMILARITY of such a window,
   until all of it is covered.  Steps 2 and 3 follow for these links too.

No value is too frequent: an exact repeat of MIN_WORDS words or more is found, and
so is a near repeat, whichever of the earlier documents holds it.

Words are split at ASCII white space and compare with A-Z lower-cased.

Defined cases: texts under MIN_WORDS words have no passages; null counts as empty;
rows equal in doc_id and text are one document, whose passages repeat nowhere
else; a null doc_id comes first in order; repeats within a document alone are
left alone; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rolled_shingles, row_key, small, text_batches, text_blocks, tidy, word_hashes

SHINGLE, MIN_WORDS, MIN_WINDOW, N_HASHES, MIN_HASHES, SIMILARITY = 5, 50, 46, 8, 2, 0.8
#: Most documents of a value that link to all earlier ones of them; shingles of a window that a near repeat shares.
FEW, NEED = 32, 37
#: Candidates that are compared at once, and elements that are sorted at once.
BLOCK, SORTED = 1 << 10, 1 << 22
#: The bits of a min-hash value that hold its function's number.
LAST = 7
#: Most rows of two 64-bit keys that are broadcast.
BROADCAST_KEYS = 1_000_000
#: Most combinations of places of a document and a reference that are formed one by one, and of several at once.
REPEATED, MANY = 1 << 12, 1 << 18
#: Shingles that are handed on at once.
BATCH = 1 << 18
#: Shingles whose windows are searched at once, and bytes of text that are hashed at once: their arrays fit a core's cache.
SEARCHED, HASHED = 1 << 16, 1 << 16
#: Windows, or links, that are dealt to buckets at once.
BLOCKED = 1 << 20
_MIX = np.random.default_rng(11).integers(1, 2**63, size=(16, 2), dtype=np.uint64)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_IN_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])


def _function(h: np.ndarray, f: int) -> np.ndarray:
    """Hash function f of shingle hashes; its number is in the last three bits."""
    x = (h ^ _MIX[f, 0]) * (_MIX[f, 1] | np.uint64(1))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x & ~np.uint64(LAST)) | np.uint64(f)


def compact_windows(hashes: np.ndarray, starts: np.ndarray, t: int, f: int) -> tuple[np.ndarray, ...]:
    """(value, document, left, centre, right) of the windows of concatenated documents; starts: where each begins, and the end.  Positions count from the document's start."""
    n = len(hashes)
    empty = np.zeros(0, np.int64)
    if n < t:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    x = _function(hashes, f)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    key = (x & ~mask) | np.arange(n, dtype=np.uint64)
    low, width = key, 1
    while width < t:  # minima of windows of doubled width
        step = min(width, t - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    ends = np.repeat(starts[1:], np.diff(starts))[: len(low)]
    least = np.zeros(n, bool)
    least[(low[np.arange(t, len(low) + t) <= ends] & mask).astype(np.int64)] = True
    at = np.flatnonzero(least)
    doc, keys = np.searchsorted(starts, at, "right") - 1, key[at]
    base = starts[doc]
    reach = []
    for turn in (slice(None, None, -1), slice(None)):
        # the nearest smaller centre of the same document: who is not smaller hands on the one that it has come to
        d, k = np.append(doc[turn], -1), np.append(keys[turn], 0)
        to = np.minimum(np.arange(1, len(d) + 1), len(d) - 1)
        more = np.arange(len(d) - 1)
        while len(more):
            more = more[(k[to[more]] > k[more]) & (d[to[more]] == d[more])]
            to[more] = to[to[more]]
        reach.append(np.where(d[to] == d, np.append(at[turn], 0)[to], -1)[:-1][turn])
    left = np.where(reach[0] >= 0, reach[0] + 1, base)
    right = np.where(reach[1] >= 0, reach[1], starts[doc + 1]) - 1
    return x[at], doc, left - base, at - base, right - base


def pack(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Centres with how far their windows reach to either side; a reach over MIN_WINDOW tells nothing more, as a longer common passage has another centre there."""
    return centre << 12 | np.minimum(centre - left, MIN_WINDOW) << 6 | np.minimum(right - centre, 63)


def unpack(x: int) -> tuple[int, int, int]:
    return x >> 12, x >> 6 & 63, x & 63


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _id, which is never null, and _k, which tells the different texts of one id apart and is 0 where an id has one text only."""
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))))
    content = row_key(F.col("doc_id"), F.col("text"))[0]
    several = rows.select("_id", content).groupBy("_id").agg(F.min("_k1").alias("lo"), F.max("_k1").alias("hi")).where("lo < hi").select("_id", F.lit(True).alias("_several"))
    several = materialize(several, "ids")
    if not several.limit(1).count():
        return rows.withColumn("_k", F.lit(0).cast("bigint"))
    return rows.join(small(several), "_id", "left").withColumn("_k", F.when(F.col("_several"), content).otherwise(0)).drop("_several")


def _texts(rows: DataFrame) -> DataFrame:
    """(_id, _k, text binary) of keyed rows."""
    text_batches(rows.sparkSession)
    return rows.select("_id", "_k", F.col("text").cast("binary").alias("text"))


def _shingles(batch):
    """(row, hashes): the shingles of each text of a batch."""
    texts = batch.column("text")
    for a, b in text_blocks(texts, HASHED):
        h, n = rolled_shingles(*word_hashes(texts.slice(a, b - a)), SHINGLE)
        end = np.cumsum(n)
        for i in range(b - a):
            yield a + i, h[end[i] - n[i] : end[i]]


def _bucket_keys(n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash partitioning deals to it (MurmurHash3 of an int, seed 42): buckets fill the partitions evenly.  Another hash would cost evenness alone."""
    keys, start = np.full(n, -1, np.int64), 0
    while (keys < 0).any():
        k = np.arange(start, start + 16 * n + 64, dtype=np.uint32)
        start += len(k)
        turned = lambda x, by: x << np.uint32(by) | x >> np.uint32(32 - by)
        h = np.uint32(42) ^ turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = (turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        to = (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % n
        new = keys[to] < 0
        keys[to[new][::-1]] = k[new][::-1]
    return keys.astype(np.int32)


def _value_bucket(v: np.ndarray, n: int) -> np.ndarray:
    return ((v.view(np.uint64) >> np.uint64(3)) % np.uint64(n)).astype(np.int32)


def _id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    x = ids.view(np.uint64)
    return ((x ^ x >> np.uint64(11) ^ x >> np.uint64(29)).view(np.int64) % n).astype(np.int32)


def _id_bucket_of(c: str, n: int):
    """The same as a column."""
    x = F.col(c).bitwiseXOR(F.shiftrightunsigned(c, 11)).bitwiseXOR(F.shiftrightunsigned(c, 29))
    return F.pmod(x, F.lit(n).cast("bigint")).cast("int")


def _blocks(bucket: np.ndarray, columns: dict, lists: dict, names: list[str], keys: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket, with its rows' values end to end as bytes: Spark moves few rows of bytes in place of many of numbers.  lists: (how many values each row has, the values); columns that are not given are empty; keys: what stands for each bucket."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    kept, n = np.unique(bucket, return_counts=True)
    ends = np.append(0, np.cumsum(n))
    arrays = {}
    for x, c in columns.items():
        arrays[x] = c[order], ends
    for x, (size, c) in lists.items():
        first, sorted_size = (np.cumsum(size) - size)[order], size[order]
        arrays[x] = c[_span_index(first, sorted_size)], np.append(0, np.cumsum(sorted_size))[ends]
    out = [pa.array(kept if keys is None else keys[kept], pa.int32())]
    for x in names:
        c, at = arrays.get(x, (np.zeros(0, np.int64), np.zeros_like(ends)))
        out.append(pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((at * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]))
    return pa.RecordBatch.from_arrays(out, ["b", *names])


def _unblocked(batches, kinds: dict) -> dict:
    """The columns of all blocks of a partition, each end to end."""
    out = {x: [] for x in kinds}
    for b in batches:
        for x, parts in out.items():
            column = b.column(x)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
            if at[-1] > at[0]:
                parts.append(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].copy())
    return {x: (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(kinds[x]) for x, parts in out.items()}


def _schema(names) -> str:
    return ", ".join(["b int", *(f"{x} binary" for x in names)])


#: Blocks of windows, with a centre's low and high half apart, the high one being zero nearly always; whether a place is open and its value frequent.
_WINDOWS = {"v": np.int64, "_id": np.int64, "_k": np.int64, "low": np.uint32, "high": np.uint32}
_SHARED = _WINDOWS | {"n": np.int32}
_LEFT = _WINDOWS | {"open": np.uint8, "frequent": np.uint8}
#: Blocks of links: a value's document and an earlier one, how many places they have of it, and these end to end; marks: places with their documents.
_LINKS = {"v": np.int64, "_id": np.int64, "_k": np.int64, "n": np.int32, "ref_id": np.int64, "ref_k": np.int64, "n_cs": np.int32, "n_rcs": np.int32, "cs": np.int64, "rcs": np.int64}
_MARKS = {"mark_id": np.int64, "mark_k": np.int64, "mark": np.int64}


def _halves(c: np.ndarray) -> dict:
    return {"low": (c & 0xFFFFFFFF).astype(np.uint32), "high": (c >> 32).astype(np.uint32)}


def _centres(rows: dict) -> np.ndarray:
    return rows["high"].astype(np.int64) << 32 | rows["low"]


def document_windows(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """The windows of keyed docs with their centres and how far they reach, in blocks by their min-hash value."""

    def run(batches):
        ids, ks, parts, out, size, held = [], [], [], [], 0, 0

        def searched():
            starts = np.cumsum([0, *map(len, parts)])
            h, i, k = np.concatenate(parts), np.array(ids, np.int64), np.array(ks, np.int64)
            for f in range(N_HASHES):
                v, d, lo, c, r = compact_windows(h, starts, MIN_WINDOW, f)
                out.append((v.view(np.int64), i[d], k[d], pack(lo, c, r)))
            ids.clear(), ks.clear(), parts.clear()
            return sum(len(x[0]) for x in out[-N_HASHES:])

        def flush():
            v, i, k, c = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return _blocks(_value_bucket(v, len(keys)), {"v": v, "_id": i, "_k": k, **_halves(c)}, {}, list(_WINDOWS), keys)

        for b in batches:
            for row, h in _shingles(b):
                if len(h) >= MIN_WINDOW:
                    ids.append(b.column("_id")[row].as_py()), ks.append(b.column("_k")[row].as_py()), parts.append(h)
                    size += len(h)
                if size >= SEARCHED:
                    held += searched()
                    size = 0
                if held >= BLOCKED:
                    yield flush()
                    held = 0
        if parts:
            searched()
        if out:
            yield flush()

    return _texts(docs).mapInArrow(tidy(run), _schema(_WINDOWS))


def _order(*keys: np.ndarray) -> np.ndarray:
    """np.lexsort without the keys that are the same everywhere."""
    told = [k for k in keys if len(k) and k.min() != k.max()]
    return np.lexsort(told) if told else np.arange(len(keys[0]))


def _by_document(v: np.ndarray, ids: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, value, n) of windows in the order of value and document: where each document of a value begins, which of these begin a value, and how many documents that has."""
    new_v = np.append(True, v[1:] != v[:-1])
    doc = np.flatnonzero(new_v | np.append(True, (ids[1:] != ids[:-1]) | (ks[1:] != ks[:-1])))
    value = np.flatnonzero(new_v[doc])
    return doc, value, np.diff(np.append(value, len(doc)))


def _shared(batches, keys: np.ndarray):
    """From all windows of a value: for each document of a value that several have, all its centres, how many have it, and the first of them with its centres (none for the first itself), in blocks by document."""
    rows = _unblocked(batches, _WINDOWS)
    v = rows["v"]
    order = np.argsort(v)
    sorted_v = v[order]
    same = sorted_v[1:] == sorted_v[:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(v) else order
    if not len(order):
        return
    v, ids, ks, c = v[order], rows["_id"][order], rows["_k"][order], _centres({x: rows[x][order] for x in ("low", "high")})
    del rows, sorted_v, same
    order = _order(c, ks, ids, v)
    v, ids, ks, c = v[order], ids[order], ks[order], c[order]
    doc, value, n = _by_document(v, ids, ks)
    ends, ref, n = np.append(doc, len(v)), np.repeat(value, n), np.repeat(n, n)
    kept = np.flatnonzero(n > 1)
    for part in np.split(kept, np.arange(BLOCKED, len(kept), BLOCKED)):
        if not len(part):
            continue
        a, r = doc[part], doc[ref[part]]
        size = ends[part + 1] - a
        ref_size = np.where(a == r, 0, ends[ref[part] + 1] - r)
        columns = {"v": v[a], "_id": ids[a], "_k": ks[a], "n": n[part].astype(np.int32), "ref_id": ids[r], "ref_k": ks[r], "n_cs": size.astype(np.int32), "n_rcs": ref_size.astype(np.int32)}
        yield _blocks(_id_bucket(ids[a], len(keys)), columns, {"cs": (size, c[_span_index(a, size)]), "rcs": (ref_size, c[_span_index(r, ref_size)])}, list(_LINKS), keys)


_CHAIN = ["_id", "_k", "ref_id", "ref_k", "a0", "a1", "b0", "b1"]


def _chained(rows: dict, need: int):
    """The chains of blocks of links, once each."""
    size, ref_size = rows["n_cs"].astype(np.int64), rows["n_rcs"].astype(np.int64)
    at = np.flatnonzero(ref_size)
    heads = [rows[x][at] for x in _CHAIN[:4]]
    order = _order(*heads[::-1])
    at, heads = at[order], [x[order] for x in heads]
    first = np.flatnonzero(np.logical_or.reduce([np.append(True, x[1:] != x[:-1]) for x in heads])) if len(at) else at
    count = np.diff(np.append(first, len(at)))
    first, count = first[count >= need], count[count >= need]
    starts = np.cumsum(size) - size, np.cumsum(ref_size) - ref_size
    step = max(1, MANY // 16)
    for a in range(0, len(first), step):
        f, n = first[a : a + step], count[a : a + step]
        part = at[_span_index(f, n)]
        sides = [(rows[x][_span_index(s[part], z[part])], z[part]) for x, s, z in (("cs", starts[0], size), ("rcs", starts[1], ref_size))]
        found = _chain_batches([x[f] for x in heads], _Links(rows["v"][part], n, sides), need)
        found = [pd.DataFrame(dict(zip(_CHAIN, x))) for x in found]
        if found:
            yield pd.concat(found).drop_duplicates()


def _typed(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of some of a schema's columns, the others being null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _first_chains(batches, buckets: int):
    """From all links of a document to first documents: their chains, and blocks of its windows by document."""
    rows = _unblocked(batches, _LINKS)
    if not len(rows["v"]):
        return
    schema = pa.schema([*((x, pa.int64()) for x in _CHAIN), ("b", pa.int32()), *((x, pa.binary()) for x in _NAMED)])
    for found in _chained(rows, MIN_HASHES):
        yield _typed({x: found[x].to_numpy() for x in _CHAIN}, schema)
    wins = {x: np.repeat(rows[x], rows["n_cs"]) for x in ("v", "_id", "_k", "n")} | _halves(rows["cs"])
    b = _blocks(_id_bucket(wins["_id"], buckets), wins, {}, list(_SHARED))
    yield _typed({"b": b.column("b")} | {f"w{x}": b.column(x) for x in _SHARED}, schema)


_NAMED = [f"w{x}" for x in _SHARED]


def uncovered(ids: np.ndarray, ks: np.ndarray, place: np.ndarray, spans: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which places of documents no span (id, k, s, e) covers with a whole shingle."""
    i, k, s, e = spans
    ids, ks, at = np.concatenate([i, ids]), np.concatenate([k, ks]), np.concatenate([s, place])
    is_place = np.arange(len(at)) >= len(i)
    order = _order(is_place, at, ks, ids)
    ids, ks = ids[order], ks[order]
    doc = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (ks[1:] != ks[:-1])))[: len(ids)]
    # how far the spans of the document go that have begun
    to = np.maximum.accumulate(doc << 40 | np.concatenate([e, np.zeros(len(place), np.int64)])[order]) & (1 << 40) - 1
    out = np.zeros(len(at), bool)
    out[order] = to < at[order] + SHINGLE
    return out[len(i) :]


def _left(batches, keys: np.ndarray):
    """From blocks of windows and the spans of their documents: the windows, with whether their place is open, in blocks by value."""
    out, size = [], 0

    def flush():
        rows = {x: np.concatenate([o[x] for o in out]) for x in _LEFT}
        out.clear()
        return _blocks(_value_bucket(rows["v"], len(keys)), rows, {}, list(_LEFT), keys)

    for batch in batches:
        for at in range(batch.num_rows):
            b = batch.slice(at, 1)
            rows = _unblocked([b.rename_columns([x.removeprefix("w") if x in _NAMED else x for x in b.schema.names])], _SHARED)
            spans = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.column("spans").flatten().flatten()]
            is_open = uncovered(rows["_id"], rows["_k"], _centres(rows) >> 12, tuple(spans))
            frequent = rows.pop("n") > FEW
            out.append(rows | {"open": is_open.astype(np.uint8), "frequent": frequent.astype(np.uint8)})
            size += len(frequent)
            if size >= BLOCKED:
                yield flush()
                size = 0
    if out:
        yield flush()


def _met(batches, keys: np.ndarray):
    """From all windows of a value, in blocks by document: links of the open places of a rare one to all earlier documents, and the places of a frequent one that has open places."""
    rows = _unblocked(batches, _LEFT)
    if not len(rows["v"]):
        return
    c, names = _centres(rows), [*_LINKS, *_MARKS]
    order = _order(c, rows["_k"], rows["_id"], rows["v"])
    v, ids, ks, c, is_open, frequent = (x[order] for x in (rows["v"], rows["_id"], rows["_k"], c, rows["open"].astype(bool), rows["frequent"].astype(bool)))
    del rows
    doc, value, n = _by_document(v, ids, ks)
    ends, opened = np.append(doc, len(v)), np.add.reduceat(is_open, doc, dtype=np.int64)
    marked = np.repeat(np.add.reduceat(opened, value) > 0, np.add.reduceat(np.diff(ends), value)) & frequent
    at = np.flatnonzero(marked)
    for part in np.split(at, np.arange(BLOCKED, len(at), BLOCKED)):
        if len(part):
            yield _blocks(_id_bucket(ids[part], len(keys)), {"mark_id": ids[part], "mark_k": ks[part], "mark": (c[part] >> 12) * 2 + is_open[part]}, {}, names, keys)
    ref, before = np.repeat(value, n), np.arange(len(doc)) - np.repeat(value, n)
    mine = np.flatnonzero((opened > 0) & ~frequent[doc] & (before > 0))
    only, rank = c[is_open], np.append(0, np.cumsum(is_open))
    for part in np.split(mine, np.arange(BLOCKED // FEW, len(mine), BLOCKED // FEW)):
        if not len(part):
            continue
        d, r = np.repeat(part, before[part]), _span_index(ref[part], before[part])
        size, ref_size = opened[d], ends[r + 1] - doc[r]
        a, e = doc[d], doc[r]
        columns = {"v": v[a], "_id": ids[a], "_k": ks[a], "ref_id": ids[e], "ref_k": ks[e], "n_cs": size.astype(np.int32), "n_rcs": ref_size.astype(np.int32)}
        yield _blocks(_id_bucket(ids[a], len(keys)), columns, {"cs": (size, only[_span_index(rank[a], size)]), "rcs": (ref_size, c[_span_index(e, ref_size)])}, names, keys)


def _more_chains(batches):
    """From all links and marks of a document: chains, and its marked places."""
    rows = _unblocked(batches, _LINKS | _MARKS)
    schema = pa.schema([*((x, pa.int64()) for x in _CHAIN), ("places", pa.list_(pa.int64()))])
    for found in _chained(rows, MIN_HASHES):
        yield _typed({x: found[x].to_numpy() for x in _CHAIN}, schema)
    ids, ks, mark = (rows[x] for x in _MARKS)
    if len(ids):
        order = _order(mark, ks, ids)
        ids, ks, mark = ids[order], ks[order], mark[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (ks[1:] != ks[:-1]))
        kept = np.flatnonzero(new | np.append(True, mark[1:] != mark[:-1]))
        ids, ks, mark, new = ids[kept], ks[kept], mark[kept], np.flatnonzero(new[kept])
        yield _typed({"_id": ids[new], "_k": ks[new], "places": pa.ListArray.from_arrays(pa.array(np.append(new, len(ids)).astype(np.int32)), pa.array(mark))}, schema)


def _span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, end to end."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class _Links:
    """The links of a batch's rows as arrays: for each link its row, value, and places on both sides."""

    def __init__(self, v: np.ndarray, count: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]):
        """v: the values; count: how many links each row has; sides: the places of all links, end to end, and how many each has."""
        self.v, self.count, self.first = v, count, np.cumsum(count) - count
        self.places, self.n = [x for x, _ in sides], [n for _, n in sides]
        self.at = [np.cumsum(n) - n for n in self.n]

    @classmethod
    def of_column(cls, column: pa.ListArray):
        v, *sides = column.flatten().flatten()
        return cls(v.to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64), [(x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()).astype(np.int64)) for x in sides])

    def of_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some rows, and the row of each."""
        return _span_index(self.first[rows], self.count[rows]), np.repeat(rows, self.count[rows])

    def side(self, links: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of some links on one side, end to end, and how many each has."""
        return self.places[k][_span_index(self.at[k][links], self.n[k][links])], self.n[k][links]


def _chain_rows(links: _Links, rows: np.ndarray, need: int) -> tuple[np.ndarray, ...]:
    """(row, a0, a1, b0, b1) of the chains of some rows: all combinations of the places of a value, split by diagonal and then by position, that need functions agree on."""
    at, of = links.of_rows(rows)
    (cs, m), (rcs, n) = links.side(at, 0), links.side(at, 1)
    link = np.repeat(np.arange(len(at)), m * n)
    nth = np.arange(len(link)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
    x, y = cs[(np.cumsum(m) - m)[link] + nth // n[link]], rcs[(np.cumsum(n) - n)[link] + nth % n[link]]
    row, bit = of[link], np.int64(1) << (links.v[at] & LAST)[link]
    c, rc, back, ahead = x >> 12, y >> 12, np.minimum(x >> 6 & 63, y >> 6 & 63), np.minimum(x & 63, y & 63)
    order = np.lexsort((c - rc, row))
    row, d = row[order], (c - rc)[order]
    group = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] - d[:-1] > SHINGLE)]))
    by_place = np.lexsort((c[order], group))
    order, row, group = order[by_place], row[by_place], group[by_place]
    c, rc, back, ahead, bit = c[order], rc[order], back[order], ahead[order], bit[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (c[1:] - c[:-1] > 2 * MIN_WINDOW)]))
    enough = np.bitwise_count(np.bitwise_or.reduceat(bit, first)) >= need
    ends = (np.minimum.reduceat(c - back, first), np.maximum.reduceat(c + ahead, first), np.minimum.reduceat(rc - back, first), np.maximum.reduceat(rc + ahead, first))
    return row[first][enough], *(x[enough] for x in ends)


def _regions(links: _Links, row: int, need: int) -> list[tuple[int, int, int, int]]:
    """(a0, a1, b0, b1) of texts that repeat themselves, whose combinations of places are too many: places of either side that lie together are one region, and regions chain that need functions agree on."""
    at, _ = links.of_rows(np.array([row]))
    sides, value = [], links.v[at]
    for k in (0, 1):
        y, n = links.side(at, k)
        order = np.argsort(y >> 12, kind="stable")
        y, link = y[order], np.repeat(np.arange(len(at)), n)[order]
        c = y >> 12
        first = np.flatnonzero(np.concatenate([[True], c[1:] - c[:-1] > 2 * MIN_WINDOW]))
        region = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
        held = np.unique(link * len(first) + region)
        bounds = np.minimum.reduceat(c - (y >> 6 & 63), first), np.maximum.reduceat(c + (y & 63), first)
        sides.append((held // len(first), held % len(first), *bounds))
    (l1, r1, a0, a1), (l2, r2, b0, b1) = sides
    lo = np.searchsorted(l2, l1)
    n = np.searchsorted(l2, l1, "right") - lo
    mine, theirs = np.repeat(np.arange(len(l1)), n), _span_index(lo, n)
    pair = r1[mine] * len(b0) + r2[theirs]
    order = np.argsort(pair, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) > 0]))
    bits = np.bitwise_or.reduceat((np.int64(1) << (value & LAST))[l1[mine]][order], first)
    kept = pair[order][first][np.bitwise_count(bits) >= need]
    i, j = kept // len(b0), kept % len(b0)
    return list(zip(a0[i].tolist(), a1[i].tolist(), b0[j].tolist(), b1[j].tolist()))


def _chain_batches(heads: list[np.ndarray], links: _Links, need: int) -> list[list[np.ndarray]]:
    """From the links of documents and references (heads: _id, _k, ref_id, ref_k): chains along nearby diagonals, with the range of shingles that each may cover on both sides."""
    size = np.add.reduceat(links.n[0] * links.n[1], links.first)
    plain = np.flatnonzero(size <= REPEATED)
    wide = [(i, *x) for i in np.flatnonzero(size > REPEATED).tolist() for x in _regions(links, i, need)]
    found = [tuple(np.array(x, np.int64) for x in zip(*wide))] if wide else []
    for part in np.split(plain, np.flatnonzero(np.diff(np.cumsum(size[plain]) // MANY)) + 1):
        if len(part):
            found.append(_chain_rows(links, part, need))
    # ranges of references are widened to multiples of 32, so that many documents ask for the same one
    return [[*(h[row] for h in heads), a0, a1, np.maximum(0, b0) // 32 * 32, -(-b1 // 32) * 32] for row, a0, a1, b0, b1 in found]


def _chains(batches, need: int):
    """The chains of rows of links, see _chain_batches."""
    for b in batches:
        if b.num_rows:
            heads = [b.column(x).to_numpy(zero_copy_only=False) for x in _CHAIN[:4]]
            for cols in _chain_batches(heads, _Links.of_column(b.column("links")), need):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], _CHAIN)


def _once(batches):
    """Batches without rows whose document has come before."""
    seen = set()
    for b in batches:
        keys = list(zip(b.column("_id").to_pylist(), b.column("_k").to_pylist()))
        new = [key not in seen and not seen.add(key) for key in keys]
        b = b if all(new) else b.filter(pa.array(new, pa.bool_()))
        if b.num_rows:
            yield b


def _slices(batches):
    """Shingle hashes of the asked ranges of each text."""
    names = ["_id", "_k", "a0", "a1", "own", "hashes"]
    for b in _once(batches):
        heads = [b.column(x).to_numpy(zero_copy_only=False) for x in names[:2]]
        ends = b.column("asked").offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        a0, a1, own = (x.to_numpy(zero_copy_only=False) for x in b.column("asked").flatten().flatten())
        at, sizes, parts, size = [], [], [], 0

        def flush():
            rows, offsets = np.concatenate([np.full(y - x, i) for i, x, y in at]), np.concatenate([[0], np.cumsum(np.concatenate(sizes)) * 8]).astype(np.int32)
            lists = np.concatenate([np.arange(x, y) for _, x, y in at])
            hashes = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts))])
            cols = [*(h[rows] for h in heads), a0[lists], a1[lists]]
            at.clear(), sizes.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(own[lists], pa.bool_()), hashes], names)

        for row, h in _shingles(b):
            x, y = int(ends[row]), int(ends[row + 1])
            start = np.maximum(a0[x:y], 0)
            n = np.maximum(np.minimum(a1[x:y] + 1, len(h)) - start, 0)
            at.append((row, x, y)), sizes.append(n), parts.append(h[_span_index(start, n)])
            size += int(n.sum())
            if size >= BATCH:
                yield flush()
                size = 0
        if at:
            yield flush()


def repeated_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges [s, e) of shingles of a that are near-duplicates of a range of b."""
    # small numbers in place of hashes, so that a set is an array of flags
    both = np.concatenate([a, b])
    order = both.argsort()
    new = np.ones(len(both), bool)
    new[1:] = both[order[1:]] != both[order[:-1]]
    names = np.empty(len(both), np.int64)
    names[order] = new.cumsum() - 1
    size = int(np.count_nonzero(new))
    a, b = names[: len(a)], names[len(a) :]
    held = np.zeros(size, bool)
    held[b] = True
    out: list[tuple[int, int]] = []
    work = [(held[a].nonzero()[0], 2 * SHINGLE, False)]
    while work:
        h, gap, failed = work.pop()
        cuts = [0, *((h[1:] - h[:-1] > gap + 1).nonzero()[0] + 1).tolist(), len(h)]
        narrower = gap // 2 if gap > 2 else 0
        if failed and len(cuts) == 2:  # this gap does not split what failed as a whole
            if gap > 0:
                work.append((h, narrower, True))
            continue
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x == y or h[y - 1] + SHINGLE - h[x] < MIN_WORDS:
                continue
            s, e = int(h[x]), int(h[y - 1]) + 1
            mine, other = np.zeros(size, bool), np.zeros(size, bool)
            mine[a[s:e]] = True
            where = mine[b].nonzero()[0]
            far = (where[1:] - where[:-1] > 4 * SHINGLE).nonzero()[0] + 1
            if len(far):  # chance shingles far from the passage
                ends = np.concatenate([[0], far, [len(where)]])
                k = int(np.argmax(np.diff(ends)))
                where = where[ends[k] : ends[k + 1]]
            other[b[where[0] : where[-1] + 1]] = True
            if np.count_nonzero(mine & other) >= SIMILARITY * np.count_nonzero(mine | other):
                out.append((s, e))
            elif gap > 0:
                work.append((h[x:y], narrower, True))
    return out


def _verified(batches):
    names = ["_id", "_k", "ref_id", "s", "e"]
    for b in batches:
        out = [[] for _ in names]
        for i, k, ref, a0, x, y in zip(*[b.column(c).to_pylist() for c in ("_id", "_k", "ref_id", "a0", "hashes", "ref_hashes")]):
            for s, e in repeated_runs(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
                for o, val in zip(out, (i, k, ref, max(0, a0) + s, max(0, a0) + e + SHINGLE - 1)):
                    o.append(val)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)


def _only(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of the documents in keys (_id, _k), without a shuffle of texts where the keys are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), ["_id", "_k"], how)


def _linked(links: DataFrame, name: str, need: int = MIN_HASHES) -> DataFrame:
    """The chains of links (v, _id, _k, cs, ref_id, ref_k, rcs) that need functions agree on."""
    pairs = links.groupBy("_id", "_k", "ref_id", "ref_k").agg(F.collect_list(F.struct("v", "cs", "rcs")).alias("links")).where(F.size("links") >= need)
    return materialize(pairs.mapInArrow(tidy(lambda b: _chains(b, need)), "_id bigint, _k bigint, ref_id bigint, ref_k bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint").distinct(), name)


def thinned(h: np.ndarray, place: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last place of each shingle in every MIN_WINDOW - 1 shingles, open if one of those between is: a window of MIN_WINDOW that holds a place holds one of them, so a text that repeats a word has few."""
    order = np.lexsort((place, place // (MIN_WINDOW - 1), h[place]))
    place, is_open = place[order], is_open[order]
    cell, g = place // (MIN_WINDOW - 1), h[place]
    first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])]))
    last = np.append(first[1:], len(place)) - 1
    opened = np.logical_or.reduceat(is_open, first)
    two = last > first
    return np.concatenate([place[first], place[last[two]]]), np.concatenate([opened, opened[two]])


def _around(batches):
    """A row for the listed places of a text that have the same shingle g and the same shingles around them: whether one of them is open, and 32 bits of each shingle up to MIN_WINDOW - 1 before and after them, 0 beyond the text."""
    seen, powers = {}, np.multiply.accumulate(np.full(2 * MIN_WINDOW - 1, 0x9E3779B97F4A7C15, np.uint64))
    for b in _once(batches):
        ids, ks, asked = b.column("_id").to_numpy(), b.column("_k").to_numpy(), b.column("places")
        out, rows, size = [], [], 0

        def flush():
            g, is_open, x, n, place = (np.concatenate(c) for c in zip(*out))
            row = np.concatenate(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(place))
            around = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(np.arange(len(g) + 1, dtype=np.int32) * x.shape[1] * 4), pa.py_buffer(np.ascontiguousarray(x))])
            out.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[row]), pa.array(ks[row]), lists, pa.array(is_open), around], ["g", "_id", "_k", "places", "open", "around"])

        for i, h in _shingles(b):
            # a place comes twice, once with its last bit set, where it is open
            marks = np.unique(asked[i].values.to_numpy())
            last = np.append(marks[1:] >> 1 != marks[:-1] >> 1, True)
            place, is_open = thinned(h, marks[last] >> 1, (marks[last] & 1).astype(bool))
            line = np.zeros(len(h) + 2 * MIN_WINDOW - 2, np.uint32)
            line[MIN_WINDOW - 1 : MIN_WINDOW - 1 + len(h)] = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
            x = np.lib.stride_tricks.sliding_window_view(line, 2 * MIN_WINDOW - 1)[place]
            content = x.astype(np.uint64) @ powers
            order = np.lexsort((place, content, h[place]))
            place, content = place[order], content[order]
            first = np.flatnonzero(np.concatenate([[True], (content[1:] != content[:-1]) | (h[place][1:] != h[place][:-1])]))
            n, opened, me = np.diff(np.append(first, len(place))), np.logical_or.reduceat(is_open[order], first), (int(ids[i]), int(ks[i]))
            # a closed row is a reference only: the first document with its content will do
            kept = opened.copy()
            for k, key in enumerate(zip(h[place[first]].tolist(), content[first].tolist())):
                if seen.get(key, me) >= me:
                    seen[key], kept[k] = me, True
            place, first = place[np.repeat(kept, n)], first[kept]
            out.append((h[place[np.cumsum(n[kept]) - n[kept]]], opened[kept], x[order[first]], n[kept], place))
            rows.append(np.full(len(first), i))
            size += len(first) * x.shape[1]
            if size >= BATCH:
                yield flush()
                size = 0
        if out:
            yield flush()


def _of_several(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which elements of the rows of x occur in rows of several documents; zeros never do."""
    flat, owner, out = x.ravel(), np.repeat(doc, x.shape[1]), np.zeros(x.size, bool)
    parts = -(-x.size // SORTED)
    for r in range(parts):
        at = np.flatnonzero((flat % np.uint32(parts) == r) & (flat > 0))
        if len(at):
            at = at[np.argsort(flat[at], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], flat[at][1:] != flat[at][:-1]]))
            several = np.minimum.reduceat(owner[at], first) < np.maximum.reduceat(owner[at], first)
            out[at] = np.repeat(several, np.diff(np.append(first, len(at))))
    return out.reshape(x.shape)


def _window_sums(flags: np.ndarray, width: int = MIN_WINDOW) -> np.ndarray:
    """How many flags each window of some elements of a row holds."""
    sums = np.zeros((len(flags), flags.shape[1] + 1), np.int16)
    np.cumsum(flags, axis=1, out=sums[:, 1:])
    return sums[:, width:] - sums[:, :-width]


def _spread(windows: np.ndarray) -> np.ndarray:
    """The elements that windows of MIN_WINDOW elements hold."""
    edge = np.zeros((len(windows), windows.shape[1] + MIN_WINDOW), np.int16)
    edge[:, : windows.shape[1]] += windows
    edge[:, MIN_WINDOW:] -= windows
    return np.cumsum(edge, axis=1)[:, :-1] > 0


def near_places(x: np.ndarray, doc: np.ndarray, is_open: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(row, earlier row, ranges) of what is around one shingle in documents, rows in the order of doc: open rows, each with rows of earlier documents that repeat what is around it.  Ranges of a row's elements are exact copies of a window, with the first row that holds it, or near repeats that are verified."""
    shared = _of_several(x, doc)
    alive = _window_sums(shared) >= NEED
    rows = np.flatnonzero(alive.any(axis=1))
    if not is_open[rows].any():
        return []
    x, shared, alive, doc, is_open = x[rows], shared[rows], alive[rows], doc[rows], is_open[rows]
    n, width = x.shape
    # exact copies: the first row of each window's content
    first, step = np.zeros(alive.shape, np.int64), max(1, SORTED // n)
    for a in range(0, alive.shape[1], step):
        b = min(a + step, alive.shape[1])
        content = np.zeros((n, b - a), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(MIN_WINDOW):
                content = content * np.uint64(0x9E3779B97F4A7C15) + x[:, a + k : b + k]
        at, back = np.unique(content.ravel(), return_index=True, return_inverse=True)[1:]
        first[:, a:b] = (at[back.ravel()] // (b - a)).reshape(n, b - a)
    exact = (_window_sums(x > 0) == MIN_WINDOW) & (doc[first] < doc[:, None]) & is_open[:, None]
    copies: dict = {}
    for i, j in zip(*(c.tolist() for c in np.nonzero(exact))):
        ranges = copies.setdefault((i, int(first[i, j])), [])
        if ranges and ranges[-1][1] == j + MIN_WINDOW - 1:
            ranges[-1] = (ranges[-1][0], j + MIN_WINDOW)
        else:
            ranges.append((j, j + MIN_WINDOW))
    out = [(int(rows[i]), int(rows[j]), ranges) for (i, j), ranges in copies.items()]
    # what else may be in a repeat
    left = shared & _spread(alive) & ~_spread(exact) & is_open[:, None]
    if not left.any():
        return out
    names = np.zeros(x.shape, np.int64)
    words, names[shared] = np.unique(x[shared], return_inverse=True)
    names[~shared] = len(words)
    held = np.unique((names * n + np.arange(n)[:, None])[shared])
    at = np.searchsorted(held, np.arange(len(words) + 1) * n)
    holders = held % n
    mark = np.full(len(words) + 1, -1)
    # copies of what is around are compared once
    with np.errstate(over="ignore"):
        content = (x * np.multiply.accumulate(np.full(width, 0x9E3779B97F4A7C15, np.uint64))).sum(axis=1)
    unlike = np.zeros(n, bool)
    unlike[np.unique(content, return_index=True)[1]] = True
    for u in np.flatnonzero(left.any(axis=1)).tolist():
        before = int(np.searchsorted(doc, doc[u]))
        mine, which, times = np.unique(names[u][shared[u]], return_inverse=True, return_counts=True)
        # rarest first: who shares NEED of them holds one outside the most frequent that make less than NEED
        order = np.argsort(at[mine + 1] - at[mine], kind="stable")
        rare = mine[order[: len(mine) - np.searchsorted(np.cumsum(times[order][::-1]), NEED)]]
        found = holders[_span_index(at[rare], at[rare + 1] - at[rare])]
        count = np.bincount(found[found < before], minlength=1)
        near = np.flatnonzero(count.astype(bool) & unlike[: len(count)])
        near = near[np.argsort(-count[near], kind="stable")]
        mark[mine] = np.arange(len(mine))
        where, todo = np.flatnonzero(shared[u]), left[u].copy()
        for part in np.split(near, np.arange(BLOCK, len(near), BLOCK)):
            if not todo.any():
                break
            # which of this row's elements each candidate has
            has = mark[names[part]]
            holds = np.zeros((len(part), len(mine) + 1), bool)
            holds[np.arange(len(part))[:, None], has] = True
            flags = np.zeros((len(part), width), bool)
            flags[:, where] = holds[:, which]
            # shingles of a repeat that only one side has are a quarter of the shared ones at most
            sums = _window_sums(flags)
            some = ((sums >= NEED) & (_window_sums(flags & todo) > 0)).any(axis=1)
            # fewer than four different shared shingles make no repeat with one that is not shared
            some &= (holds[:, :-1].sum(axis=1) >= 4) | (sums == MIN_WINDOW).any(axis=1)
            if not some.any():
                continue
            part, has, flags, sums, holds = part[some], has[some], flags[some], sums[some], holds[some]
            alone = (has < 0) & (x[part] > 0)
            lone = np.repeat(_window_sums(alone, NEED)[:, MIN_WINDOW - NEED :].min(axis=1)[:, None], alive.shape[1], axis=1)
            if len(mine) == len(where):
                # where a shingle is nowhere twice: those between a window's first and last shared one
                at_e = np.zeros((len(part), len(mine) + 1), np.int16)
                at_e[np.arange(len(part))[:, None], has] = np.arange(width)
                spots = np.where(flags[:, where], at_e[:, which], -1)
                low, high = np.full(flags.shape, width, np.int16), np.full(flags.shape, -1, np.int16)
                low[:, where], high[:, where] = np.where(spots < 0, width, spots), spots
                for step in (1, 2, 4, 8, 16, MIN_WINDOW - 32):
                    low, high = np.minimum(low[:, :-step], low[:, step:]), np.maximum(high[:, :-step], high[:, step:])
                sure = ((has >= 0).sum(axis=1) == flags.sum(axis=1))[:, None] & (high - low < MIN_WINDOW + 4 * SHINGLE) & (high >= low)
                total = np.zeros((len(part), width + 1), np.int16)
                np.cumsum(alone, axis=1, out=total[:, 1:])
                line = np.arange(len(part))[:, None]
                lone = np.where(sure, np.maximum(lone, total[line, high + 1] - total[line, np.minimum(low, width)]), lone)
            fits = flags & _spread((sums >= NEED) & (5 * (sums + 1) >= 4 * (MIN_WINDOW + lone)))
            most = fits.sum(axis=1)
            for k in np.argsort(-most, kind="stable")[: np.count_nonzero(most)].tolist():
                if not (fits[k] & todo).any():
                    continue
                a, b = np.flatnonzero(x[u]), np.flatnonzero(x[part[k]])
                runs = [(int(a[s]), int(a[e - 1]) + 1) for s, e in repeated_runs(x[u][a], x[part[k]][b])]
                if any(todo[s:e].any() for s, e in runs):
                    out.append((int(rows[u]), int(rows[part[k]]), runs))
                    for s, e in runs:
                        todo[s:e] = False
                    if not todo.any():
                        break
        mark[mine] = -1
    return out


def _partition(batches) -> pa.Table | None:
    """The rows of a partition, if it has any."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _near_links(batches):
    """Links of open places to earlier documents with a like place, from partitions that hold all places of a shingle; spans: the word ranges that are verified already."""
    names = ["v", "_id", "_k", "cs", "ref_id", "ref_k", "rcs", "spans"]
    rows = _partition(batches)
    if rows is None:
        return
    g, ids, ks = (rows.column(c).to_numpy() for c in ("g", "_id", "_k"))
    column, lists = rows.column("around").chunk(0), rows.column("places").chunk(0)
    order = np.lexsort((lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()], ks, ids, g))
    g, ids, ks, is_open = g[order], ids[order], ks[order], rows.column("open").to_numpy()[order]
    around = np.frombuffer(column.buffers()[2], np.uint32, len(g) * (2 * MIN_WINDOW - 1), int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])).reshape(len(g), -1)
    doc = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (ks[1:] != ks[:-1]) | (g[1:] != g[:-1])]))
    ends = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    out = {x: [] for x in names}
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if doc[a] == doc[b - 1] or not is_open[a:b].any():
            continue
        for i, j, runs in near_places(around[order[a:b]], doc[a:b], is_open[a:b]):
            i, j = a + i, a + j
            mine, theirs = (lists[int(order[k])].values.to_numpy() for k in (i, j))
            spans = [{"s": p + s - MIN_WINDOW + 1, "e": p + e - MIN_WINDOW + SHINGLE} for p in mine.tolist() for s, e in runs]
            sides = [pack(p - MIN_WINDOW, p, p + MIN_WINDOW) for p in (mine, theirs)]
            for x, val in zip(names, (g[i], ids[i], ks[i], sides[0], ids[j], ks[j], sides[1], spans)):
                out[x].append(val)
    kinds = {"cs": pa.list_(pa.int64()), "rcs": pa.list_(pa.int64()), "spans": pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))}
    yield from pa.table({x: pa.array(c, kinds.get(x, pa.int64())) for x, c in out.items()}).to_batches(max_chunksize=1 << 14)


def _compared(docs: DataFrame, chains: DataFrame, name: str) -> DataFrame:
    """(_id, _k, ref_id, s, e): the word ranges of the chains that hold when their shingles are compared."""
    asked = chains.select("_id", "_k", "a0", "a1", F.lit(True).alias("own")).union(chains.select("ref_id", "ref_k", "b0", "b1", F.lit(False))).distinct()
    asked = materialize(asked.groupBy("_id", "_k").agg(F.collect_list(F.struct("a0", "a1", "own")).alias("asked")), "asked")
    slices = materialize(_asked_texts(docs, asked).mapInArrow(tidy(_slices), "_id bigint, _k bigint, a0 bigint, a1 bigint, own boolean, hashes binary"), "slices")
    mine = slices.where("own").drop("own")
    refs = slices.where("NOT own").select(F.col("_id").alias("ref_id"), F.col("_k").alias("ref_k"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("hashes").alias("ref_hashes"))
    both = chains.join(mine, ["_id", "_k", "a0", "a1"]).join(refs, ["ref_id", "ref_k", "b0", "b1"])
    found = materialize(both.select("_id", "_k", "ref_id", "a0", "hashes", "ref_hashes").mapInArrow(tidy(_verified), "_id bigint, _k bigint, ref_id bigint, s bigint, e bigint"), name)
    discard(asked, slices)
    return found


def _asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (_id, _k, ...) with the texts of its documents; rows that are equal in both can come several times."""
    return _only(_texts(docs), asked.select("_id", "_k")).join(asked.hint("shuffle_hash"), ["_id", "_k"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(_id, _k, spans array<struct<s, e, ref_id>>, n_dup_words) of keyed docs: the word ranges [s, e) of each document that repeat a passage of an earlier one; only documents that have some."""
    # windows and links move in blocks; most values are of one document: those go no further
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _bucket_keys(n)
    shared = document_windows(docs, keys).repartition("b").mapInArrow(tidy(lambda b: _shared(b, keys)), _schema(_LINKS))
    kinds = ", ".join(f"{x} bigint" for x in _CHAIN)
    first = materialize(shared.repartition("b").mapInArrow(tidy(lambda b: _first_chains(b, n)), f"{kinds}, b int, " + ", ".join(f"{x} binary" for x in _NAMED)), "first_chains", scan=True)
    chains = first.where("b IS NULL").select(*_CHAIN)
    spans = _compared(docs, chains, "first_spans")
    bounds = spans.select("_id", "_k", "s", "e").distinct().groupBy(_id_bucket_of("_id", n).alias("b")).agg(F.collect_list(F.struct("_id", "_k", "s", "e")).alias("spans"))
    wins = first.where("b IS NOT NULL").select("b", *_NAMED).join(bounds.hint("shuffle_hash"), "b", "left")
    wins = wins.withColumn("spans", F.coalesce("spans", F.array().cast(bounds.schema["spans"].dataType)))
    met = wins.mapInArrow(tidy(lambda b: _left(b, keys)), _schema(_LEFT)).repartition("b").mapInArrow(tidy(lambda b: _met(b, keys)), _schema([*_LINKS, *_MARKS]))
    met = materialize(met.repartition("b").mapInArrow(tidy(_more_chains), f"{kinds}, places array<bigint>"), "more_links")
    # a rare value: all its earlier documents, the first among them again
    more = met.where("places IS NULL").select(*_CHAIN)
    # a frequent value: what stands around its shingle
    asked, near = met.where("places IS NOT NULL").select("_id", "_k", "places"), None
    if asked.limit(1).count():
        around = _asked_texts(docs, asked).mapInArrow(tidy(_around), "g bigint, _id bigint, _k bigint, places array<bigint>, open boolean, around binary")
        near = materialize(around.repartition("g").mapInArrow(tidy(_near_links), "v bigint, _id bigint, _k bigint, cs array<bigint>, ref_id bigint, ref_k bigint, rcs array<bigint>, spans array<struct<s: bigint, e: bigint>>"), "near_links", scan=True)
        found = _linked(near.drop("spans"), "near_chains", 1)
        # a passage may go on over places that are covered: all that the two documents share is compared at once too
        pair = ["_id", "_k", "ref_id", "ref_k"]
        whole = found.union(chains.join(found.select(*pair).distinct().hint("shuffle_hash"), pair, "left_semi").select(*chains.columns))
        whole = whole.groupBy(*pair).agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
        more = more.union(found).union(whole)
    more = materialize(more.distinct().join(chains, chains.columns, "left_anti"), "more_chains")
    discard(first, met)
    spans = spans.union(_compared(docs, more, "more_spans"))
    if near is not None:
        # what is verified around a place, unless the longer comparison has it
        sure = near.select("_id", "_k", "ref_id", F.explode("spans").alias("x")).select("_id", "_k", "ref_id", "x.s", "x.e").distinct()
        wider = spans.select(*(F.col(c).alias(f"_{c}") for c in spans.columns))
        inside = (F.col("__id") == F.col("_id")) & (F.col("__k") == F.col("_k")) & (F.col("_ref_id") == F.col("ref_id")) & (F.col("_s") <= F.col("s")) & (F.col("_e") >= F.col("e"))
        spans = spans.union(sure.join(wider.hint("shuffle_hash"), inside, "left_anti"))
    spans = spans.groupBy("_id", "_k").agg(F.array_sort(F.collect_set(F.struct("s", "e", "ref_id"))).alias("spans"))
    union = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))
    return materialize(spans.withColumn("n_dup_words", union["n"]), "spans")


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each text of a binary array has."""
    counts = np.zeros(len(texts), np.int64)
    for x, y in text_blocks(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + x : texts.offset + y + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        begins = _IN_WORD[data]
        inside = begins.copy()
        begins[1:] &= ~inside[:-1]
        first = ends[:-1][np.diff(ends) > 0] - ends[0]
        begins[first] = inside[first]  # words end with their text
        counts[x:y] = np.diff(np.searchsorted(np.flatnonzero(begins), ends - ends[0]))
    return counts


def mark_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_dup_words, spans) for every row of docs."""
    docs = keyed(docs)
    found = repeated_passages(docs)
    text_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array(word_counts(texts), pa.int64())

    rows = docs.select("doc_id", "_id", "_k", words(F.col("text").cast("binary")).alias("n_words"))
    out = rows.join(found, ["_id", "_k"], "left")
    named = F.transform("spans", lambda x: x.withField("ref_id", F.when(x["ref_id"] != -(2**63), x["ref_id"])))
    return out.select("doc_id", "n_words", F.coalesce("n_dup_words", F.lit(0)).cast("long").alias("n_dup_words"), F.coalesce(named, F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def cut_words(text: str, spans) -> str:
    """text without the word ranges [s, e) of sorted spans, each with the white space after it."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s, e in spans:
        s, e = places[min(s, len(places) - 1)], places[min(e, len(places) - 1)]
        out.append(text[at : max(at, s)])
        at = max(at, e)
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, without the passages that repeat one of an earlier document; a document of which nothing is left goes.  n_chars, where there is one, follows the text."""
    rows = keyed(docs)
    found = repeated_passages(rows).select("_id", "_k", F.col("spans").alias("_spans"))
    keys = found.select("_id", "_k")
    whole = _only(rows, keys, "left_anti").select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, bounds: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t or "", [*zip(x[::2], x[1::2])]) for t, x in zip(texts, bounds)])

    bounds = F.flatten(F.transform("_spans", lambda x: F.array(x["s"], x["e"])))
    hit = _only(rows, keys).join(found.hint("shuffle_hash"), ["_id", "_k"]).withColumn("text", cut("text", bounds))
    hit = hit.where(F.col("text").rlike(_WORD.pattern))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(hit.select(*docs.columns))
