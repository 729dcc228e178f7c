"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a narrow table (under 200 bytes a row) that are broadcast.
BROADCAST_ROWS = 200_000

FILES_A_CORE, TEXT_ROWS = 1, 1000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillflow-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other table has; the driver deletes it when it ends."""
    root = f"{shared_dir(spark)}/quillflow-{uuid.uuid4().hex}"
    at, files = _file_system(spark, root)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{root}/{name}"


def discard(*tables: DataFrame) -> None:
    """Deletes working tables that nothing reads any more."""
    for t in tables:
        at, files = _file_system(t.sparkSession, t.working_path)
        files.delete(at, True)


def materialize(df: DataFrame, name: str, scan: bool = False, few: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, so a lost executor costs no recomputation.

    few: a table of a bounded number of rows, written by FILES_A_CORE tasks a core at most.
    scan: a pass over whole texts, after which the executors settle.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df if not few else df.coalesce(FILES_A_CORE * max(2, spark.sparkContext.defaultParallelism))
    # on a mounted folder, working tables need no side files of check sums: each would cost an executor a process
    raw = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    # nothing reads a written table's shuffles again: their files go at once, not when the driver happens to collect garbage
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        out.write.options(**raw).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if scan:
        settle(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.working_path = path
    return table


def settle(spark: SparkSession) -> None:
    """Lets every executor collect its garbage and give the heap's free part back, after a pass over whole texts and before Python workers take memory beside it."""
    n = max(2, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def text_batches(spark: SparkSession) -> None:
    """Lets Arrow hand Python TEXT_ROWS rows at once where the session has Spark's own default of 10,000, which is meant for narrow rows: whole texts of any length come in a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has max_rows at most; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that name a row by its content: rows with equal content share them, and a recomputed task finds them again."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit("second"), *cols).alias("_k2")]


def shingle_hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of every n-word shingle, words joined by a space; fewer words than n, but not none, are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.array([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[n - 1 :])], np.uint64)


def text_blocks(texts: pa.Array, block: int = 1 << 18):
    """Ranges [a, b) of the rows of a binary array whose texts make about block bytes, one longer text being a range of its own."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + block, "right")) - 1)
        yield a, min(b, len(texts))
        a = b


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): a 64-bit hash of every word (run without ASCII white space, A-Z lower-cased) of a binary array's texts, and how many words each text has.

    A word's hash is a polynomial in its bytes, mixed; prefix sums give it for all words at once.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = int(ends[-1] - ends[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < n)]  # words end with their text
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        low = (data + ((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low * power, out=sums[1:])
        # sums grow from the word's first byte: dividing by its power makes them equal wherever the word stands
        back = np.full(int(start[-1]) + 1 if len(start) else 0, _INVERSE)
        back[:1] = 1
        x = (sums[stop] - sums[start]) * np.multiply.accumulate(back)[start]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32), np.diff(np.searchsorted(start, ends))


def rolled_shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the n-word shingles of texts given as word hashes end to end; texts of fewer words have none."""
    many = np.maximum(counts - n + 1, 0)
    if not many.any():
        return np.zeros(0, np.uint64), many
    with np.errstate(over="ignore"):
        x = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            x = x * _BASE + words[k : len(words) - n + 1 + k]
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    return (x ^ x >> np.uint64(32))[at], many


def release_memory() -> None:
    """Gives memory that is free in this process back to the machine: a Python worker idles beside its executor's JVM between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function for mapInArrow that gives memory back when its partition ends."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        release_memory()

    return tidied
