"""Registered evaluation queries: metrics, aggregates, gates, calibration, QA scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, browse, evaluate, fusion
from ..sources.readers import table
from .retrieval import _BM25, _DENSE, _PAGES, _asked, _fused, _hits, _page_legs, _top


def _gold(s, d):
    """Each passage with the documents that hold it; none makes it out of the corpus."""
    q = _asked(s, d).select("query_id", F.col("text").alias("head"))
    docs = table(s, d, "documents").select("doc_id", "text")
    found = docs.join(bm25.sized_broadcast(q), F.contains("text", "head")).groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("relevant"))
    out = q.select("query_id").join(found, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))
    cat = F.when(F.size("relevant") == 0, "out_of_corpus").when(F.col("query_id") % 3 == 0, "figure").otherwise("factual")
    return out.select("query_id", cat.alias("category"), "relevant")


def _run(s, d, k=10, lang=None):
    keep = None if lang is None else F.col("lang") == lang
    h = _hits(s, d, k, keep)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id")))), lambda x: x["id"])
    return h.groupBy("query_id").agg(ids.alias("retrieved"))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


M = evaluate.METRICS


def metrics_per_query(s, d):
    return _r(evaluate.per_query(_gold(s, d), _run(s, d)), *M)


def metrics_macro(s, d):
    return _r(evaluate.macro(evaluate.per_query(_gold(s, d), _run(s, d))), *M)


def regression_gate(s, d):
    g = _gold(s, d)
    mean = lambda lang: evaluate.macro(evaluate.per_query(g, _run(s, d, lang=lang))).where("category = 'ALL'")
    return _r(evaluate.gate(mean(None), mean("en")), "base", "new", "delta", "rel")


def paired_delta(s, d):
    g = _gold(s, d)
    a, b = evaluate.per_query(g, _run(s, d)), evaluate.per_query(g, _run(s, d, lang="en"))
    return _r(evaluate.paired(a, b, "mrr"), "mean_delta")


def page_rescore(s, d):
    g = _gold(s, d).withColumn("relevant", F.array_distinct(F.transform("relevant", lambda x: F.concat(F.lit("all::p"), F.floor(x.cast("bigint") / 5).cast("string")))))
    r = _run(s, d).withColumn("retrieved", F.transform("retrieved", lambda x: F.concat(F.lit("all::p"), F.floor(x.cast("bigint") / 5).cast("string"), F.lit("::c"), x)))
    return _r(evaluate.rescore_pages(g, r), *M)


def latency_ranks(s, d):
    return _r(evaluate.latency(table(s, d, "events"), "value", ["event_type"]), "mean")


def category_spread(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("category"), F.col("value").alias("score"))
    return _r(evaluate.category_spread(e), "mean")


def _confidence(s, d):
    top = _hits(s, d, 1).select("query_id", "score")
    return _gold(s, d).select("query_id", F.when(F.col("category") != "out_of_corpus", F.when(F.col("query_id") % 2 == 0, "table").otherwise("factual")).otherwise("out_of_corpus").alias("category")).join(top, "query_id", "left").withColumn("score", F.round("score", 6))


def calibrate_refusal(s, d):
    return _r(evaluate.calibrate_refusal(_confidence(s, d)), "threshold")


def calibrate_cascade(s, d):
    rows = table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, "figure").when(F.col("event_id") % 3 == 1, "factual").otherwise("x").alias("category"), (F.col("event_id") % 71 / 100.0).alias("score"))
    return _r(evaluate.calibrate_cascade(rows), "threshold")


def _answers(s, d):
    n = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Int", "Float", "Str", "List", "None")]), (n % 5 + 1).cast("int"))
    number = (n % 50).cast("string")
    gold = F.when(n % 5 == 0, number).when(n % 5 == 1, F.concat(number, F.lit(".25"))).when(n % 5 == 2, F.concat(F.lit("'Model "), F.col("source"), F.lit("' (best)"))).when(n % 5 == 3, F.concat(F.col("lang"), F.lit("|"), F.col("source"))).otherwise("Not answerable")
    pred = F.when(n % 5 == 0, F.when(n % 3 == 0, number).when(n % 3 == 1, "seven").otherwise(((n + 1) % 50).cast("string")))
    pred = pred.when(n % 5 == 1, F.when(n % 3 == 0, F.concat(number, F.lit(".26"))).when(n % 3 == 1, F.concat(number, F.lit(".9%"))).otherwise("n/a"))
    pred = pred.when(n % 5 == 2, F.when(n % 3 == 0, F.concat(F.lit("model "), F.col("source"))).when(n % 3 == 1, F.concat(F.lit("mode "), F.col("source"), F.lit("x"))).otherwise("other"))
    pred = pred.when(n % 5 == 3, F.when(n % 3 == 0, F.concat(F.col("source"), F.lit("|"), F.upper("lang"))).otherwise(F.col("source"))).otherwise(F.when(n % 3 == 0, "Not answerable").otherwise("src"))
    return table(s, d, "documents").select("doc_id", "lang", kind.alias("format"), gold.alias("gold"), pred.alias("pred"))


def qa_scores(s, d):
    return evaluate.qa_score(_answers(s, d)).select("doc_id", F.round("score", 6).alias("score"))


def qa_acc_f1(s, d):
    return _r(evaluate.acc_f1(evaluate.qa_score(_answers(s, d))), "acc", "recall", "precision", "f1")


def _gold_pages(s, d):
    return _gold(s, d).select("query_id", "category", F.explode(F.array_distinct(F.transform("relevant", lambda x: F.floor(x.cast("bigint") / 5)))).alias("page"))


def page_recall_curve(s, d):
    text, _ = _page_legs(s, d)
    ranked = fusion.first_pages(text).withColumn("rank", F.col("rank") + 1)
    return _r(evaluate.page_recall_curve(_gold_pages(s, d), ranked), "recall")


def miss_decomposition(s, d):
    text, seen = _page_legs(s, d)
    pages = lambda df: fusion.first_pages(df).withColumn("rank", F.col("rank") + 1)
    fused = fusion.weighted_page_rrf(text, seen, weight=6.0, top=50).select("query_id", "page", (F.col("rank") + 1).alias("rank"))
    return evaluate.miss_decomposition(_gold_pages(s, d), pages(text), pages(seen), fused.where("rank <= 12"), k=1)


def generation_overrides(s, d):
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(
        n.alias("query_id"), F.when(n % 3 == 0, "out_of_corpus").otherwise("factual").alias("category"), F.when(n % 11 == 0, None).when(n % 4 == 0, " Not stated in the provided context. x").otherwise("text").alias("answer"), (n % 2).alias("n_facts"),
        (n % 10 / 10.0).alias("faithfulness"), (n % 7 / 10.0).alias("answer_relevance"), (n % 9 / 10.0).alias("answer_correctness"),
    )
    return evaluate.overrides(rows)


def citation_grounding(s, d):
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(n.alias("query_id"), F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 7, n % 3, n % 3)).alias("cited"), F.array(n % 3, n % 4).alias("retrieved"))
    return _r(evaluate.citation_grounding(rows), "grounding")


def harvest_flags(s, d):
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(n.alias("query_id"), F.when(n % 3 == 0, "out_of_corpus").otherwise("factual").alias("category"), "text", (n % 10 / 10.0).alias("faithfulness"), F.when(n % 4 != 0, n % 7 / 10.0).alias("answer_relevance"), (n % 9 / 10.0).alias("context_precision"), (n % 5 == 0).alias("refused"), F.lit("a").alias("answer"), (n % 6).alias("n_retrieved"))
    return evaluate.harvest_flags(rows).select("query_id", F.array_join("flags", "|").alias("flags"))


def judge_summary(s, d):
    e = table(s, d, "events").select((F.col("user_id")).alias("query_id"), F.col("event_type").alias("metric"), F.col("value").alias("score"))
    return _r(evaluate.judge_summary(e), "mean", "std")


def bootstrap_ci(s, d):
    e = table(s, d, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("double").alias("delta"))
    return evaluate.bootstrap_ci(e, resamples=200)


def run_pivot(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b").otherwise("c").alias("run"), F.col("value").alias("score"))
    return _r(browse.pivot_runs(e, "score", ["a", "b", "c"]), "a", "b", "c")


def count_by_category(s, d):
    l = table(s, d, "labels")
    return l.cube("quality", "toxic").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def request_metrics(s, d):
    e = table(s, d, "events")
    bucket = F.when(F.col("value") < 10, "lt10").when(F.col("value") < 100, "lt100").otherwise("rest")
    return e.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.get_json_object("props", "$.k").try_cast("int") > 50).alias("over"))


def visible_terms(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"), F.size(T.tokens(F.col("text"))).alias("n"))


_GOLD = """g0 AS (SELECT item_id AS query_id, list_sort(list(d.doc_id::VARCHAR) FILTER (d.doc_id IS NOT NULL)) AS relevant FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
gold AS (SELECT query_id, CASE WHEN len(coalesce(relevant, [])) = 0 THEN 'out_of_corpus' WHEN query_id % 3 = 0 THEN 'figure' ELSE 'factual' END AS category, coalesce(relevant, []) AS relevant FROM g0)"""
_EN = _top(10, "d.lang = 'en'").replace("hits AS", "hits_en AS")


def _scores(hits: str, out: str) -> str:
    return f"""{out} AS (SELECT g.query_id, g.category,
coalesce(sum(CASE WHEN rank < 5 AND list_contains(relevant, doc_id::VARCHAR) THEN 1 / log2(rank + 2) END) / nullif(list_sum(list_transform(range(1, least(len(any_value(relevant)), 5) + 1), lambda i: 1 / log2(i + 1))), 0), 0) AS ndcg_at_5,
coalesce(count(*) FILTER (list_contains(relevant, doc_id::VARCHAR)) / nullif(len(any_value(relevant)), 0), 0)::DOUBLE AS recall_at_10,
coalesce(1.0 / (min(rank) FILTER (list_contains(relevant, doc_id::VARCHAR)) + 1), 0)::DOUBLE AS mrr FROM gold g LEFT JOIN {hits} h ON h.query_id = g.query_id GROUP BY g.query_id, g.category)"""


_EVAL = f"WITH {_BM25}, {_top(10)}, {_EN}, {_GOLD}, {_scores('hits', 'sa')}, {_scores('hits_en', 'sb')}"
_MEAN = "SELECT avg(ndcg_at_5) AS ndcg_at_5, avg(recall_at_10) AS recall_at_10, avg(mrr) AS mrr FROM {} WHERE category <> 'out_of_corpus'"
_NEAR = "list_sort(list(value))[round_even({q} * (count(*) - 1), 0)::BIGINT + 1]"
_QA = r"""SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END
WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN CASE WHEN abs(v - (v + 0.01)) <= 0.01 * (v + 0.01) THEN 1.0 ELSE 0 END WHEN doc_id % 3 = 1 THEN CASE WHEN 0.65 <= 0.01 * (v + 0.65) OR abs(v / 100 - (v + 0.65)) <= 0.01 * (v + 0.65) OR abs(v * 100 - (v + 0.65)) <= 0.01 * greatest(v * 100, v + 0.65) THEN 1.0 ELSE 0 END ELSE 0 END
WHEN 2 THEN CASE WHEN doc_id % 3 = 2 THEN CASE WHEN 1 - levenshtein(g, 'other') / greatest(length(g), 5) > 0.5 THEN 1 - levenshtein(g, 'other') / greatest(length(g), 5) ELSE 0 END WHEN doc_id % 3 = 1 THEN 1 - levenshtein(g, p) / greatest(length(g), length(p)) ELSE CASE WHEN 1 - levenshtein(g, 'model ' || source) / greatest(length(g), length('model ' || source)) > 0.5 THEN 1 - levenshtein(g, 'model ' || source) / greatest(length(g), length('model ' || source)) ELSE 0 END END
WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END
ELSE CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE CASE WHEN 1 - levenshtein('not answerable', 'src') / 14 > 0.5 THEN 1 - levenshtein('not answerable', 'src') / 14 ELSE 0 END END END::DOUBLE AS score
FROM (SELECT doc_id, lang, source, doc_id % 50 + 0.25 AS v, 'model ' || source AS g, 'mode ' || source || 'x' AS p FROM documents)"""

ORACLES = {
    "metrics_per_query": f"{_EVAL} SELECT query_id, category, round(ndcg_at_5, 6) AS ndcg_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr, 6) AS mrr FROM sa",
    "metrics_macro": f"{_EVAL} SELECT coalesce(category, 'ALL') AS category, count(*) AS n, round(avg(ndcg_at_5), 6) AS ndcg_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr FROM sa WHERE category <> 'out_of_corpus' GROUP BY ROLLUP (category)",
    "regression_gate": f"{_EVAL}, a AS (UNPIVOT ({_MEAN.format('sa')}) ON ndcg_at_5, recall_at_10, mrr INTO NAME metric VALUE base), b AS (UNPIVOT ({_MEAN.format('sb')}) ON ndcg_at_5, recall_at_10, mrr INTO NAME metric VALUE new) SELECT metric, round(base, 6) AS base, round(new, 6) AS new, round(new - base, 6) AS delta, round(CASE WHEN base > 0 THEN (new - base) / base ELSE 0 END, 6) AS rel, CASE WHEN base > 0 THEN (new - base) / base ELSE 0 END < -0.05 AS regressed FROM a JOIN b USING (metric)",
    "paired_delta": f"{_EVAL} SELECT count(*) AS n, round(avg(sb.mrr - sa.mrr), 6) AS mean_delta, count(*) FILTER (sb.mrr - sa.mrr > 1e-9) AS better, count(*) FILTER (sb.mrr - sa.mrr < -1e-9) AS worse, count(*) FILTER (abs(sb.mrr - sa.mrr) <= 1e-9) AS equal FROM sa JOIN sb USING (query_id)",
    "page_rescore": f"""{_EVAL}, gp AS (SELECT query_id, category, list_distinct(list_transform(relevant, lambda x: x::BIGINT // 5)) AS rel FROM gold),
pg AS (SELECT query_id, doc_id // 5 AS page, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) - 1 AS rank FROM hits GROUP BY query_id, doc_id // 5),
z AS (SELECT gp.query_id, category, rank, len(rel) AS n, list_contains(rel, page) AS hit FROM gp LEFT JOIN pg USING (query_id)),
y AS (SELECT query_id, category, any_value(n) AS n, coalesce(sum(CASE WHEN hit AND rank < 5 THEN 1 / log2(rank + 2) END), 0) AS dcg, count(*) FILTER (hit AND rank < 5) AS h5, count(*) FILTER (hit AND rank < 10) AS h10, min(rank) FILTER (hit) AS f FROM z GROUP BY 1, 2)
SELECT query_id, category, CASE WHEN n > 0 THEN round(coalesce(dcg / nullif(list_sum(list_transform(range(1, h5 + 1), lambda i: 1 / log2(i + 1))), 0), 0), 6) END AS ndcg_at_5, CASE WHEN n > 0 THEN round(h10 / n, 6) END AS recall_at_10, CASE WHEN n > 0 THEN round(coalesce(1.0 / (f + 1), 0)::DOUBLE, 6) END AS mrr FROM y""",
    "latency_ranks": f"SELECT event_type, count(*) AS n, {_NEAR.format(q='0.5::DOUBLE')} AS p50, {_NEAR.format(q='0.95::DOUBLE')} AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "category_spread": "SELECT event_type AS category, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS max FROM events GROUP BY 1",
    "calibrate_refusal": f"""WITH {_BM25}, {_top(1)}, {_GOLD}, r AS (SELECT category = 'out_of_corpus' AS o, round(score, 6) AS s FROM gold JOIN hits USING (query_id)),
e AS (SELECT t.s, count(*) FILTER (r.o AND r.s >= t.s) + count(*) FILTER (NOT r.o AND r.s < t.s) AS err FROM (SELECT DISTINCT s FROM r) t, r GROUP BY t.s), m AS (SELECT max(s) FILTER (o) AS hi, min(s) FILTER (NOT o) AS lo FROM r)
SELECT round(CASE WHEN hi IS NULL OR lo IS NULL THEN 0 WHEN hi < lo THEN (hi + lo) / 2 ELSE s END, 6) AS threshold, CASE WHEN hi IS NULL OR lo IS NULL OR hi < lo THEN 0 ELSE err END::BIGINT AS errors FROM m, (SELECT s, err FROM e ORDER BY err, s LIMIT 1)""",
    "calibrate_cascade": "WITH h AS (SELECT list_sort(list((event_id % 71 / 100.0)::DOUBLE)) AS l FROM events WHERE event_id % 3 = 0), t AS (SELECT list_sort(list((event_id % 71 / 100.0)::DOUBLE)) AS l FROM events WHERE event_id % 3 = 1) SELECT t.l[len(t.l) // 2 + 1] AS median_text, h.l[len(h.l) // 2 + 1] AS median_hybrid, round(greatest(0, least(1, h.l[len(h.l) // 2 + 1] + 0.05)), 6) AS threshold FROM h, t",
    "qa_scores": f"SELECT doc_id, round(score, 6) AS score FROM ({_QA})",
    "qa_acc_f1": f"SELECT n, round(acc, 6) AS acc, round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f1 FROM (SELECT count(*) AS n, avg(score) AS acc, sum(score) FILTER (doc_id % 5 <> 4) / count(*) FILTER (doc_id % 5 <> 4) AS r, sum(score) FILTER (doc_id % 5 <> 4) / count(*) FILTER (NOT (doc_id % 5 = 4 AND doc_id % 3 = 0)) AS p FROM ({_QA}))",
    "page_recall_curve": f"""{_PAGES}, {_GOLD}, gp AS (SELECT DISTINCT query_id, category, unnest(relevant)::BIGINT // 5 AS page FROM gold),
j AS (SELECT category, rank + 1 AS rank FROM gp LEFT JOIN tp USING (query_id, page)), ks AS (SELECT unnest([1, 3, 5, 10, 20, 50]) AS k)
SELECT coalesce(category, 'ALL') AS category, k::BIGINT AS k, count(*) FILTER (rank <= k) AS found, count(*) AS total, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall FROM j, ks GROUP BY GROUPING SETS ((category, k), (k))""",
    "miss_decomposition": f"""{_PAGES}, {_GOLD}, gp AS (SELECT DISTINCT query_id, unnest(relevant)::BIGINT // 5 AS page FROM gold), vp AS (SELECT DISTINCT query_id, page FROM v), f AS ({_fused(6, 12)})
SELECT CASE WHEN f.rank < 1 THEN 'hit' WHEN f.rank IS NOT NULL THEN 'ranking_loss' WHEN tp.page IS NOT NULL OR vp.page IS NOT NULL THEN 'fusion_buried' ELSE 'retriever_miss' END AS reason, count(*) AS n
FROM gp LEFT JOIN tp USING (query_id, page) LEFT JOIN vp USING (query_id, page) LEFT JOIN f USING (query_id, page) GROUP BY 1""",
    "generation_overrides": """SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'out_of_corpus' ELSE 'factual' END AS category,
CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN (doc_id % 3 = 0)::INT WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 10 / 10.0 END::DOUBLE AS faithfulness,
CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN (doc_id % 3 = 0)::INT WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 7 / 10.0 END::DOUBLE AS answer_relevance,
CASE WHEN doc_id % 11 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 9 / 10.0 END::DOUBLE AS answer_correctness FROM documents""",
    "citation_grounding": "SELECT doc_id AS query_id, CASE WHEN doc_id % 5 <> 0 THEN round((2 + (doc_id % 7 IN (doc_id % 3, doc_id % 4))::INT) / 3, 6) END AS grounding FROM documents",
    "harvest_flags": """SELECT * FROM (SELECT doc_id AS query_id, concat_ws('|', CASE WHEN doc_id % 10 < 5 THEN 'low_faithfulness' END, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 < 5 THEN 'low_answer_relevance' END, CASE WHEN doc_id % 9 < 5 THEN 'low_context_precision' END,
CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'false_refusal' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'missing_refusal' END, CASE WHEN doc_id % 6 = 0 THEN 'empty_retrieval' END) AS flags FROM documents) WHERE flags <> ''""",
    "judge_summary": "SELECT user_id AS query_id, event_type AS metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1, 2",
    "run_pivot": """WITH p AS (SELECT event_type AS category, avg(value) FILTER (event_id % 3 = 0) AS a, avg(value) FILTER (event_id % 3 = 1) AS b, avg(value) FILTER (event_id % 3 = 2) AS c FROM events GROUP BY 1)
SELECT category, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, CASE WHEN a > b AND a > c THEN 'a' WHEN b > c THEN 'b' ELSE 'c' END AS best FROM p""",
    "count_by_category": "SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n, (grouping(quality) * 2 + grouping(toxic))::BIGINT AS level FROM labels GROUP BY CUBE (quality, toxic)",
    "request_metrics": "SELECT event_type, CASE WHEN value < 10 THEN 'lt10' WHEN value < 100 THEN 'lt100' ELSE 'rest' END AS bucket, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) > 50) AS over FROM events GROUP BY 1, 2",
    "visible_terms": "SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: {'p': list_position(t, x), 'x': x}))[1:24], lambda y: y.x), ' ') AS terms, n FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS t, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM benchmark)",
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "bootstrap_ci"]}
