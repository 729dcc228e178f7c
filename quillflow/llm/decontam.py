"""Operator 5: benchmark decontamination by a prefix-filtered set join (DataFrame functions alone).

An item's windows (10 consecutive words; a shorter item is one window) are sets of
word shingles (5 words, or the whole item if it is shorter).  Exact containment of
a window needs each of its shingles, so the necessary prefix under an order by
rarity is one shingle: the rarest.

1. One pass over the documents looks up every document shingle among the
   benchmark's shingles: by 64-bit hash, then by the words themselves.  What
   matches is a list of (document, position, shingle).
2. The matches' counts order the shingles by rarity; each window whose shingles
   all occur keeps its rarest as prefix, and is joined on it.
3. Candidates pass the positional bounds (a window starts at word 0 or later) and
   the length bound (it ends within the document), and are verified by the
   shingles that cover the window: all its words are then compared.

The lookup tests each shingle against a set of LISTED hashes at most; a longer
list is joined with the hashes of all document shingles, which shuffles.

Defined cases: a null text has no words and no windows; an item with a null id
is left out; items with equal texts all count; repeated item rows count once;
repeated documents give repeated results; empty tables give results without hits;
other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, materialize, row_key, small

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Most shingles that the lookup holds in an expression; a longer list is joined.
LISTED = 50_000


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and what is not ASCII, with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows, shingles) of items (item_id, text).  windows: (wid, item_id, len, n, sids), sids holding the ids of its shingles by offset; shingles: (sid, n, h, words)."""
    texts = items.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    texts = texts.withColumn("len", F.least(F.size("words"), F.lit(window))).withColumn("n", F.least(F.col("len"), F.lit(shingle)))
    wins = texts.select("item_id", "len", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))).alias("w"))
    wins = wins.select(F.xxhash64("w", F.lit(1)).alias("wid"), "item_id", "len", "n", F.transform(F.sequence(F.lit(1), F.col("len") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n"))).alias("grams")).distinct()
    grams = wins.select("n", F.explode("grams").alias("words")).distinct()
    # the id of a shingle is a hash with another seed than the one looked up
    sid = lambda g: F.xxhash64(F.lit("sid"), g)
    by_n = F.coalesce(*[F.when(F.col("n") == k, F.xxhash64(*[F.get("words", F.lit(i)) for i in range(k)])) for k in range(1, shingle + 1)])
    return wins.withColumn("sids", F.transform("grams", sid)).drop("grams"), grams.select(sid(F.col("words")).alias("sid"), "n", by_n.alias("h"), "words")


def _positions(n: int, hashes: list[int] | None) -> Column:
    """Where the n-word shingles of the column words are: all of them, or those whose hash is listed.  A short list is a set that the expression itself holds."""
    own = "xxhash64(" + ", ".join(f"words[i + {k}]" for k in range(n)) + ")"
    every = f"sequence(0, size(words) - {n})"
    found = every if hashes is None else f"filter({every}, i -> {own} IN ({', '.join(f'{h}L' for h in hashes)}))" if hashes else "array()"
    return F.expr(f"CASE WHEN size(words) >= {n} THEN {found} END" if hashes != [] else "CAST(NULL AS array<int>)")


def _joined_matches(base: DataFrame, keyed: DataFrame, shingles: DataFrame, n: int) -> DataFrame:
    """The matches of n-word shingles by a join on their hashes."""
    own = F.transform(_positions(n, None), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("words", i + k) for k in range(n)]).alias("h")))
    spots = base.select("_k1", "_k2", F.explode(own).alias("x")).select("_k1", "_k2", "x.*")
    cand = spots.join(shingles.where(F.col("n") == n).select("h", "sid", F.col("words").alias("gram")), "h").select("_k1", "_k2", F.struct("pos", "sid", "gram").alias("c")).distinct()
    lists = cand.groupBy("_k1", "_k2").agg(F.collect_list("c").alias("cs"))
    true = F.filter("cs", lambda c: F.slice("words", c["pos"] + 1, n) == c["gram"])
    found = keyed.join(lists.hint("shuffle_hash"), ["_k1", "_k2"]).select("doc_id", "_k1", "_k2", F.size("words").alias("n_words"), F.explode(true).alias("c"))
    return found.select("doc_id", "_k1", "_k2", "n_words", "c.pos", "c.sid")


def find_matches(docs: DataFrame, shingles: DataFrame, listed: int = LISTED) -> DataFrame:
    """(doc_id, _k1, _k2, n_words, pos, sid): a row for each shingle of docs among the given ones, and one with pos and sid null for each document."""
    base = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), words_of(F.col("text")).alias("words"))
    lengths = {r["n"]: r["count"] for r in shingles.groupBy("n").count().collect()}  # SHINGLE rows at most
    few = sum(lengths.values()) <= listed
    hashes = {n: [r["h"] for r in shingles.where(F.col("n") == n).select("h").distinct().collect()] if few else [] for n in lengths}
    at = lambda n: F.transform(_positions(n, hashes[n]), lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, n).alias("own"), F.lit(n).alias("n")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<string>").alias("own"), F.lit(0).alias("n")))
    found = F.concat(none, *[F.coalesce(at(n), F.array().cast("array<struct<pos:int,own:array<string>,n:int>>")) for n in sorted(lengths) if few])
    rows = base.select("doc_id", "_k1", "_k2", F.size("words").alias("n_words"), F.explode(found).alias("x")).select("doc_id", "_k1", "_k2", "n_words", "x.*")
    if few:
        rows = materialize(rows, "found", scan=True)
        known = shingles.select(F.col("n").alias("_n"), F.col("words").alias("own"), "sid")
        hit = rows.where("pos IS NOT NULL").join(small(known), ["own"]).where(F.col("n") == F.col("_n"))
        return rows.where("pos IS NULL").select("doc_id", "_k1", "_k2", "n_words", "pos", F.lit(None).cast("long").alias("sid")).union(hit.select("doc_id", "_k1", "_k2", "n_words", "pos", "sid"))
    # the list is long: all shingles' hashes meet it in a shuffled join, and what they find is verified at the document
    out = rows.select("doc_id", "_k1", "_k2", "n_words", "pos", F.lit(None).cast("long").alias("sid"))
    keyed = base.dropDuplicates(["_k1", "_k2"])
    for n in sorted(lengths):
        out = out.union(_joined_matches(base, keyed, shingles, n))
    return out


def occurrences(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """(_k1, _k2, start, len, wid): where windows occur."""
    hits = matches.where(F.col("sid").isNotNull()).select("_k1", "_k2", "pos", "sid").distinct()
    rarity = hits.groupBy("sid").agg(F.count("*").alias("df"))
    kinds = windows.select("wid", "len", "n", "sids").distinct()
    spots = kinds.select("wid", "len", "n", "sids", F.posexplode("sids").alias("offset", "sid")).join(rarity, "sid")
    prefix = spots.groupBy("wid", "len", "n", "sids").agg(F.count("*").alias("present"), F.min(F.struct("df", "sid", "offset")).alias("rare"))
    prefix = prefix.where(F.col("present") == F.size("sids")).select("wid", "len", "n", "sids", F.col("rare.sid").alias("sid"), F.col("rare.offset").alias("offset"))
    cand = hits.join(small(materialize(prefix, "prefix", few=True)), "sid").withColumn("start", F.col("pos") - F.col("offset")).where(F.col("start") >= 0)
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("len") - F.col("n"), F.col("n")), F.array(F.col("len") - F.col("n"))))
    cover = F.when(F.col("len") == F.col("n"), F.array(F.lit(0))).otherwise(cover)
    cand = cand.select("_k1", "_k2", "wid", "len", "start", F.size(cover).alias("need"), F.explode(F.transform(cover, lambda o: F.struct(F.col("start") + o, F.get("sids", o)))).alias("at"))
    cand = cand.select("_k1", "_k2", "wid", "len", "start", "need", F.col("at.col1").alias("pos"), F.col("at.col2").alias("sid"))
    seen = cand.join(hits, ["_k1", "_k2", "pos", "sid"]).groupBy("_k1", "_k2", "wid", "len", "start", "need").count()
    return seen.where(F.col("count") == F.col("need")).select("_k1", "_k2", "start", "len", "wid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _k1, _k2, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text)."""
    windows, shingles = item_windows(items, window, shingle)
    windows, shingles = materialize(windows, "windows", few=True), materialize(shingles, "shingles", few=True)
    matches = materialize(find_matches(docs, shingles), "matches")
    occ = materialize(occurrences(matches, windows), "occurrences")
    spans = occ.groupBy("_k1", "_k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(W.partitionBy("_k1", "_k2").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))).groupBy("_k1", "_k2").agg(F.sum("new").alias("n_hit"))
    owners = small(windows.select("wid", "item_id").distinct())
    named = occ.select("_k1", "_k2", "wid").distinct().join(owners, "wid").select("_k1", "_k2", "item_id").distinct()
    named = named.groupBy("_k1", "_k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    every = matches.where(F.col("sid").isNull()).select("doc_id", "_k1", "_k2", F.col("n_words").cast("long").alias("n_words"))
    out = every.join(hit.join(named, ["_k1", "_k2"]), ["_k1", "_k2"], "left")
    return out.select(
        "doc_id", "_k1", "_k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    windows, shingles = item_windows(items, WINDOW, SHINGLE)
    windows, shingles = materialize(windows, "windows", few=True), materialize(shingles, "shingles", few=True)
    matches = materialize(find_matches(docs, shingles), "matches")
    bad = materialize(occurrences(matches, windows).select("_k1", "_k2").distinct(), "contaminated")
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), row_key(F.col("doc_id"), F.col("text")))))
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(bad) if few else bad.hint("shuffle_hash"), ["_k1", "_k2"], "left_anti").select(*docs.columns)
