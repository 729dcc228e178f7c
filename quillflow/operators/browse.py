"""Catalogue views: papers, figures, galleries, golden-set upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def papers(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper, title, pages, chunks): one row for each paper, its id for want of a title; at least one page."""
    n = chunks.groupBy("paper").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("chunks")).where("pages > 0")
    return n.join(titles, "paper", "left").select("paper", F.coalesce("title", "paper").alias("title"), "pages", "chunks")


def gallery(items: DataFrame, paper: str | None = None, decorations: bool = False, limit: int = 100) -> DataFrame:
    """Figures and tables in order of paper, page and id; small decorations only on demand."""
    out = items.where(F.col("kind").isin("figure", "table"))
    out = out if paper is None else out.where(F.col("paper") == paper)
    out = out if decorations else out.where(~F.coalesce((F.col("role") == "decoration") & (F.col("area") < 500), F.lit(False)))
    return out.orderBy("paper", "page", "chunk_id").limit(limit)


def text_filter(items: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Items with the query somewhere in the given columns, without regard to case."""
    return items.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of every key of both tables."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))
    return old.unionByName(new).withColumn("_n", n).where("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The latest row of every key, as one aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in (key, version, tie)]
    return rows.groupBy(key).agg(F.max(F.struct(version, tie, *others)).alias("m")).select(key, "m.*")


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def missing_labels(captions: DataFrame, extracted: DataFrame) -> DataFrame:
    """(paper, kind, n): labels that captions have and the extraction lacks."""
    return captions.select("paper", "kind", "n").subtract(extracted.select("paper", "kind", "n"))


def common_queries(runs: DataFrame) -> DataFrame:
    """(query_id): queries that every run has."""
    n = runs.agg(F.count_distinct("run").alias("n"))
    return runs.groupBy("query_id").agg(F.count_distinct("run").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("query_id")


def without_excluded(ranked: DataFrame, excluded: DataFrame) -> DataFrame:
    """Ranked results (query_id, id, rank from 0) without the excluded pairs (query_id, id), ranked anew."""
    kept = ranked.join(excluded, ["query_id", "id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1)


def stratified(rows: DataFrame, bucket: str, source: str, key: str, quotas: dict[str, int], seed: int = 7) -> DataFrame:
    """Alternating sample: in each bucket the sources take turns in an order by hash, up to the bucket's quota."""
    turn = F.row_number().over(W.partitionBy(bucket, source).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    place = F.row_number().over(W.partitionBy(bucket).orderBy("turn", source))
    quota = F.coalesce(*[F.when(F.col(bucket) == b, q) for b, q in quotas.items()], F.lit(0))
    return rows.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= quota)


def repeats_before(actions: DataFrame) -> DataFrame:
    """actions (run, step, action) with whether an action repeats the one before."""
    return actions.withColumn("repeated", F.coalesce(F.col("action") == F.lag("action").over(W.partitionBy("run").orderBy("step")), F.lit(False)))


def quota(requests: DataFrame, cap: int) -> DataFrame:
    """requests (ts, id) with whether each is among the first cap of its UTC day."""
    n = F.row_number().over(W.partitionBy(F.to_date("ts")).orderBy("ts", "id"))
    return requests.withColumn("allowed", n <= cap)


def first_day_requests(requests: DataFrame, cap: int) -> DataFrame:
    """(day, used, allowed, refused): the same by day as a sum that combines before the shuffle."""
    n = requests.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return n.select("day", "used", F.least("used", F.lit(cap)).alias("allowed"), F.greatest(F.col("used") - cap, F.lit(0)).alias("refused"))


def min_max(results: DataFrame) -> DataFrame:
    """results with the score scaled to 0..1 within each query; 1 where all are equal."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("scaled", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))


def dump(chunks: DataFrame, n: int = 280) -> DataFrame:
    """(chunk_id, preview): one line of each chunk."""
    return chunks.select("chunk_id", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, n).alias("preview"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new): numbers that changed between two one-row tables."""
    names = [c for c in old.columns if c in new.columns]
    long = lambda df, v: df.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "metric", v)
    return long(old, "old").join(long(new, "new"), "metric", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def pivot_runs(scores: DataFrame, metric: str, runs: list[str]) -> DataFrame:
    """(category, one column for each run, best): means by category side by side."""
    p = scores.groupBy("category").pivot("run", runs).agg(F.avg(metric))
    best = F.array_max(F.array(*[F.struct(F.col(f"`{r}`").alias("v"), F.lit(r).alias("r")) for r in runs]))["r"]
    return p.withColumn("best", best)


def prompt_version(prompts: DataFrame) -> DataFrame:
    """(name, version): the declared version and a hash of the content."""
    return prompts.select("name", F.concat_ws("-", "declared", T.content_hash(F.col("body"))).alias("version"))
