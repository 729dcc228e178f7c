"""Evaluation: retrieval metrics, aggregates, gates, calibration, QA scores.

gold: (query_id, category, relevant array<string>); runs: (query_id, retrieved array<string>), the order being the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .ingest import value_at

OUT = "out_of_corpus"


def dcg(ids: Column, relevant: Column, k: int) -> Column:
    hits = F.transform(F.slice(ids, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i.cast("double") + 2)).otherwise(0.0))
    return F.aggregate(hits, F.lit(0.0), lambda s, x: s + x)


def ideal(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i.cast("double") + 1))).otherwise(0.0)


def ndcg(ids: Column, relevant: Column, k: int = 5) -> Column:
    """nDCG with the ideal of min(relevant, k) hits; 0 without relevant ids; repeated ids count again."""
    return F.coalesce(F.try_divide(dcg(ids, relevant, k), ideal(F.least(F.size(relevant), F.lit(k)))), F.lit(0.0))


def ndcg_of_retrieved(ids: Column, relevant: Column, k: int = 5) -> Column:
    """nDCG whose ideal has only the hits that were retrieved."""
    n = F.size(F.filter(F.slice(ids, 1, k), lambda x: F.array_contains(relevant, x)))
    return F.coalesce(F.try_divide(dcg(ids, relevant, k), ideal(n)), F.lit(0.0))


def recall(ids: Column, relevant: Column, k: int = 10) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(relevant, F.slice(ids, 1, k))), F.size(F.array_distinct(relevant))), F.lit(0.0))


def reciprocal_rank(ids: Column, relevant: Column) -> Column:
    first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def per_query(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(query_id, category, ndcg_at_5, recall_at_10, mrr); a query without results scores 0."""
    g = gold.join(runs, "query_id", "left").withColumn("ids", F.coalesce("retrieved", F.array().cast("array<string>")))
    i, r = F.col("ids"), F.col("relevant")
    return g.select("query_id", "category", ndcg(i, r).alias("ndcg_at_5"), recall(i, r).alias("recall_at_10"), reciprocal_rank(i, r).alias("mrr"))


def rescore_pages(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """The same at page level: (paper, page) pairs in order of first appearance, null where the gold has no page, the ideal taken from what was retrieved."""
    pages = F.array_distinct(F.transform("retrieved", lambda c: F.concat_ws("::", F.split_part(c, F.lit("::"), F.lit(1)), F.concat(F.lit("p"), F.regexp_extract(c, r"::p(\d+)", 1)))))
    g = gold.join(runs, "query_id", "left").withColumn("ids", F.coalesce(pages, F.array().cast("array<string>")))
    i, r = F.col("ids"), F.col("relevant")
    some = F.size(r) > 0
    return g.select("query_id", "category", F.when(some, ndcg_of_retrieved(i, r)).alias("ndcg_at_5"), F.when(some, recall(i, r)).alias("recall_at_10"), F.when(some, reciprocal_rank(i, r)).alias("mrr"))


METRICS = ("ndcg_at_5", "recall_at_10", "mrr")


def macro(scores: DataFrame) -> DataFrame:
    """(category, n, means): by category and, as ALL, over every query in the corpus."""
    inside = scores.where(F.col("category") != OUT)
    return inside.rollup("category").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS]).withColumn("category", F.coalesce("category", F.lit("ALL")))


def latency(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """(by, n, p50, p95, mean): nearest ranks at round-half-even q (n - 1), from counts by value."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by)
    run = counts.withColumn("through", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("through") > F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col(value)))
    return run.groupBy(*by).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))


def gate(base: DataFrame, new: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(metric, base, new, delta, rel, regressed) of two one-row tables of means; a base of 0 or less cannot regress, a missing value is left out of the decision."""
    long = lambda df, name: df.unpivot([], list(METRICS), "metric", name)
    both = long(base.select(*METRICS), "base").join(long(new.select(*METRICS), "new"), "metric", "full")
    delta = F.col("new") - F.col("base")
    rel = F.when(delta.isNotNull(), F.when(F.col("base") > 0, delta / F.col("base")).otherwise(0.0))
    return both.select("metric", "base", "new", delta.alias("delta"), rel.alias("rel"), F.coalesce(rel < -threshold, F.lit(False)).alias("regressed"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row on queries that both runs scored: how many, the mean difference, how many got better, worse, and stayed."""
    both = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").where("x IS NOT NULL AND y IS NOT NULL")
    d = F.col("y") - F.col("x")
    return both.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 1e-9).alias("better"), F.count_if(d < -1e-9).alias("worse"), F.count_if(F.abs(d) <= 1e-9).alias("equal"))


def calibrate_refusal(rows: DataFrame) -> DataFrame:
    """One row (threshold, errors) from (category, score): the middle where the two sides are apart, else the first score with fewest on the wrong side.  Errors of all candidates come from two running counts, no pairs."""
    r = rows.where("score IS NOT NULL").withColumn("ooc", F.col("category") == OUT)
    ends = r.agg(F.max(F.when(F.col("ooc"), F.col("score"))).alias("hi"), F.min(F.when(~F.col("ooc"), F.col("score"))).alias("lo"))
    by = r.groupBy("score").agg(F.count_if("ooc").alias("o"), F.count_if(~F.col("ooc")).alias("i"))
    before = W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("score").rowsBetween(0, W.unboundedFollowing)
    err = F.sum("o").over(after) + F.coalesce(F.sum("i").over(before), F.lit(0))
    best = by.select("score", err.alias("errors")).agg(F.min(F.struct("errors", "score")).alias("b"))
    out = best.join(F.broadcast(ends))
    apart = F.col("hi") < F.col("lo")
    missing = F.col("hi").isNull() | F.col("lo").isNull()
    return out.select(F.when(missing, 0.0).when(apart, (F.col("hi") + F.col("lo")) / 2).otherwise(F.col("b.score")).alias("threshold"), F.when(missing | apart, 0).otherwise(F.col("b.errors")).cast("long").alias("errors"))


def calibrate_cascade(rows: DataFrame, text=("factual", "definitional"), hybrid=("table", "figure", "multi_hop")) -> DataFrame:
    """One row (median_text, median_hybrid, threshold): the upper median of the hybrid side plus 0.05, held to 0..1; 0.5 where a side is empty."""
    side = F.when(F.col("category").isin(*text), "text").when(F.col("category").isin(*hybrid), "hybrid")
    med = value_at(rows.withColumn("side", side).where("side IS NOT NULL"), "score", 0.5, ["side"])
    out = med.agg(F.max(F.when(F.col("side") == "text", F.col("at"))).alias("median_text"), F.max(F.when(F.col("side") == "hybrid", F.col("at"))).alias("median_hybrid"))
    some = F.col("median_text").isNotNull() & F.col("median_hybrid").isNotNull()
    return out.withColumn("threshold", F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("median_hybrid") + 0.05))).otherwise(0.5))


def category_spread(rows: DataFrame) -> DataFrame:
    """(category, n, mean, min, median, max) of score, the median being the upper one."""
    med = value_at(rows, "score", 0.5, ["category"]).withColumnRenamed("at", "median")
    return rows.where("score IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max")).join(med, "category")


def qa_score(rows: DataFrame) -> DataFrame:
    """rows (gold, pred, format Int / Float / Str / None / List of texts joined by |) with score."""
    g, p = T.clean_answer(F.col("gold")), T.clean_answer(F.col("pred"))
    as_int = F.coalesce((F.col("gold").try_cast("int") == F.floor(F.abs(F.col("pred").try_cast("double"))) * F.signum(F.col("pred").try_cast("double"))), F.lit(False)).cast("double")
    x, y = g.try_cast("double"), p.try_cast("double")
    digits = lambda c: F.when(c.cast("string").contains("."), F.length(F.substring_index(c.cast("string"), ".", -1))).otherwise(3)
    unit = F.pow(F.lit(10.0), F.greatest(F.least(digits(x), digits(y)), F.lit(2)))  # both numbers' own decimals, two at least
    close = F.lit(False)
    for v in (x / 100, x, x * 100):
        close = close | (F.abs(v - y) <= 0.01 * F.greatest(F.abs(v), F.abs(y))) | (F.rint(v * unit) == F.rint(y * unit))
    as_float = F.coalesce(close, F.lit(False)).cast("double")
    as_text = F.when(T.needs_exact_match(g), (g == p).cast("double")).otherwise(T.anls(g, p))
    sorted_ = lambda c: F.array_sort(F.transform(F.split(F.col(c), r"\|"), T.clean_answer))
    gs, ps = sorted_("gold"), sorted_("pred")
    exact = F.get(gs, F.lit(0)).try_cast("double").isNotNull() | T.needs_exact_match(F.get(gs, F.lit(0)))
    as_list = F.when(F.size(gs) != F.size(ps), 0.0).when(exact, (gs == ps).cast("double")).otherwise(F.array_min(F.zip_with(gs, ps, lambda g, p: T.anls(g, p))))
    return rows.withColumn("score", F.when(F.col("format") == "Int", as_int).when(F.col("format") == "Float", as_float).when(F.col("format").isin("Str", "None"), as_text).otherwise(as_list))


def acc_f1(scored: DataFrame, refusal: str = "Not answerable") -> DataFrame:
    """One row (n, acc, recall, precision, f1): recall over answerable golds, precision over attempted answers; 0 where there are none."""
    answerable, tried = F.col("gold") != refusal, F.col("pred") != refusal
    hit = F.coalesce(F.sum(F.when(answerable, F.col("score"))), F.lit(0.0))
    out = scored.agg(F.count("*").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("acc"), F.coalesce(F.try_divide(hit, F.count_if(answerable)), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(hit, F.count_if(tried)), F.lit(0.0)).alias("precision"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))


def overrides(rows: DataFrame) -> DataFrame:
    """rows (category, answer, n_facts, judged faithfulness / answer_relevance / answer_correctness) with the scores that follow from category and refusal alone in place."""
    refused, ooc = T.is_refusal(F.col("answer")), F.col("category") == OUT
    two = lambda c: F.when(F.col("answer").isNull(), None).when(refused, ooc.cast("double")).when(ooc, 0.0).otherwise(F.col(c))
    right = F.when(F.col("answer").isNull() | ooc | (F.col("n_facts") == 0), None).when(refused, 0.0).otherwise(F.col("answer_correctness"))
    return rows.select("query_id", "category", two("faithfulness").alias("faithfulness"), two("answer_relevance").alias("answer_relevance"), right.alias("answer_correctness"))


def citation_grounding(rows: DataFrame) -> DataFrame:
    """rows (query_id, cited, retrieved) with the share of cited ids that were retrieved; null without citations, repeats count."""
    hit = F.size(F.filter("cited", lambda c: F.array_contains(F.col("retrieved"), c)))
    return rows.select("query_id", F.try_divide(hit, F.size("cited")).alias("grounding"))


def harvest_flags(rows: DataFrame, low: float = 0.5) -> DataFrame:
    """(query_id, flags): why a logged query deserves a look; only queries with a reason."""
    refused, ooc = F.col("refused"), F.col("category") == OUT
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(F.array(*[flag(F.col(c) < low, f"low_{c}") for c in ("faithfulness", "answer_relevance", "context_precision")], flag(refused & ~ooc, "false_refusal"), flag(~refused & ooc & F.col("answer").isNotNull(), "missing_refusal"), flag(F.coalesce(F.col("n_retrieved"), F.lit(0)) == 0, "empty_retrieval")))
    return rows.select("query_id", flags.alias("flags")).where(F.size("flags") > 0)


def page_recall_curve(gold_pages: DataFrame, ranked: DataFrame, ks=(1, 3, 5, 10, 20, 50)) -> DataFrame:
    """(category, k, found, total, recall): gold pages (query_id, category, page) among the first k of a ranking (query_id, page, rank from 1), by category and ALL."""
    j = gold_pages.join(ranked.select("query_id", "page", "rank"), ["query_id", "page"], "left")
    rows = j.select("category", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank")
    out = rows.cube("category", "k").agg(F.grouping("k").alias("gk"), F.count_if(F.col("rank") <= F.col("k")).alias("found"), F.count("*").alias("total")).where("gk = 0")
    return out.select(F.coalesce("category", F.lit("ALL")).alias("category"), "k", "found", "total", (F.col("found") / F.col("total")).alias("recall"))


def miss_decomposition(gold_pages: DataFrame, text: DataFrame, visual: DataFrame, fused: DataFrame, k: int = 10, depth: int = 50) -> DataFrame:
    """(reason, n): what became of each gold page: hit, ranking_loss (in the fused list below k), fusion_buried (in a leg only), retriever_miss.  Rankings: (query_id, page, rank from 1)."""
    r = gold_pages.select("query_id", "page")
    for name, df in (("t", text), ("v", visual), ("f", fused)):
        r = r.join(df.where(F.col("rank") <= depth).groupBy("query_id", "page").agg(F.min("rank").alias(name)), ["query_id", "page"], "left")
    reason = F.when(F.col("f") <= k, "hit").when(F.col("f").isNotNull(), "ranking_loss").when(F.col("t").isNotNull() | F.col("v").isNotNull(), "fusion_buried").otherwise("retriever_miss")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def bootstrap_ci(deltas: DataFrame, value: str = "delta", resamples: int = 1000, seed: int = 0) -> DataFrame:
    """One row (mean, lo, hi): the 2.5 and 97.5 percentiles of resampled means, by Poisson weights that follow from a hash, so reruns agree and rows never leave their partition."""
    uniform = lambda b: (F.pmod(F.xxhash64(F.lit(seed), F.col("query_id"), b), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight = lambda u: F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    rows = deltas.select("query_id", F.col(value).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", weight(uniform(F.col("b"))))
    means = rows.groupBy("b").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    lo, hi = value_at(means, "m", 0.025).withColumnRenamed("at", "lo"), value_at(means, "m", 0.975).withColumnRenamed("at", "hi")
    return deltas.agg(F.avg(value).alias("mean")).join(F.broadcast(lo)).join(F.broadcast(hi))


def judge_summary(samples: DataFrame) -> DataFrame:
    """(query_id, metric, mean, std): repeated judgements of each metric; one alone has deviation 0."""
    return samples.groupBy("query_id", "metric").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"))
