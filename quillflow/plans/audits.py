"""Registered audit queries: facts, evidence, label checks, parsers, policies, classic aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..sources.readers import table

def N():
    return F.col("doc_id")


def _docs(s, d):
    return table(s, d, "documents")


def facts_in_text(s, d):
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    fact = F.when(N() % 4 == 0, F.array_join(F.slice(w, 1, 3), " ")).when(N() % 4 == 1, F.concat_ws(" ", F.get(w, F.lit(0)), F.lit("qqqq zzzz"))).when(N() % 4 == 2, "the of").otherwise("!!")
    return _docs(s, d).where("lang = 'en'").select("doc_id", audit.fact_in_text(fact, F.col("text")).alias("found"))


def tokens_present(s, d):
    text = F.concat(F.lit("red = "), (N() % 7).cast("string"), F.lit(" - 375, Yesterday; "), F.col("source"))
    token = F.when(N() % 3 == 0, "3-375").when(N() % 3 == 1, "Yes").otherwise(F.concat(F.lit("yesterday "), F.col("source")))
    return _docs(s, d).select("doc_id", audit.token_present(token, text).alias("found"))


def extraction_recall(s, d):
    gold = F.when(N() % 3 == 0, F.concat(F.lit("['"), "source", F.lit("', '"), "lang", F.lit("']"))).when(N() % 3 == 1, F.col("source")).otherwise("[broken")
    rows = _docs(s, d).select(N().alias("query_id"), F.col("lang").alias("category"), gold.alias("gold"), F.concat(F.lit("x "), F.col("source"), F.when(N() % 2 == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise("")).alias("text"))
    return audit.extraction_recall(rows)


def evidence_categories(s, d):
    ev = F.when(N() % 6 == 0, "['Chart', 'Pure-text (Plain-text)']").when(N() % 6 == 1, "['Table']").when(N() % 6 == 2, "[]").when(N() % 6 == 3, "['Pure-text (Plain-text)']").when(N() % 6 == 4, "oops").otherwise("['Figure']")
    names = F.coalesce(F.from_json(F.regexp_replace(ev, "'", '"'), "array<string>"), F.array().cast("array<string>"))
    return _docs(s, d).select("doc_id", audit.evidence_category(ev, F.when(N() % 11 == 0, "None")).alias("category"), audit.evidence_bucket(names).alias("bucket"))


def gold_pages(s, d):
    pages = F.when(N() % 2 == 0, F.array(N() % 9)).otherwise(F.array().cast("array<bigint>")).cast("array<int>")
    ids = F.array(F.concat(F.lit("x::p"), (N() % 5).cast("string"), F.lit("::c1")), F.lit("x::c2"), F.concat(F.lit("y::p"), (N() % 3).cast("string"), F.lit("::c3")))
    return _docs(s, d).select("doc_id", F.array_join(audit.gold_page_list(pages, ids).cast("array<string>"), ",").alias("pages"))


def label_check(s, d):
    c = _docs(s, d).select(N().alias("query_id"), F.when(N() % 4 == 0, "TODO").otherwise("p").alias("paper_id"), F.when(N() % 5 == 0, "TODO").otherwise("table").alias("category"), F.array_repeat(F.lit("f"), (N() % 3).cast("int")).alias("facts"), F.array_repeat(F.lit("c"), (N() % 2).cast("int")).alias("chunk_ids"), F.array_repeat(F.lit(1), (N() % 7 % 2).cast("int")).alias("pages"))
    ok, bad = audit.checked_labels(c)
    return ok.select("query_id", F.lit(True).alias("accepted")).union(bad.select("query_id", F.lit(False)))


def parsed_rewrites(s, d):
    raw = F.concat(F.lit("1. What is "), "source", F.lit("?\n- \"what IS "), "source", F.lit("?\"\n\n* other "), "lang", F.lit("\n12) third "), "lang", F.lit("\nlast"))
    return _docs(s, d).select("doc_id", F.array_join(audit.rewrites(raw, 3), "|").alias("found"))


def parsed_subqueries(s, d):
    raw = F.when(N() % 5 == 0, "1.\n-\nab").otherwise(F.concat(F.lit("1. find "), "source", F.lit("\n2) FIND "), "source", F.lit("\n- 2024 "), "lang"))
    return _docs(s, d).select("doc_id", F.array_join(audit.subqueries(raw, F.col("source"), 3), "|").alias("found"))


def caption_split(s, d):
    text = F.when(N() % 3 == 0, F.concat(F.lit("Table of "), "source")).otherwise(F.concat(F.lit("Table of "), "source", F.lit("\n\n | a | b |\n| 1 | 2 |\n")))
    c = audit.split_caption(text)
    return _docs(s, d).select("doc_id", c["name"].alias("name"), c["data"].alias("data"))


def reference_spans(s, d):
    idx = F.floor(N() / 20)
    text = F.when(idx % 10 == 7, F.concat(F.lit(" References\n"), "lang")).when(idx % 10 == 9, "A Use of data").otherwise("body of text")
    return audit.reference_spans(_docs(s, d).select((N() % 20).alias("paper"), idx.alias("idx"), text.alias("text")))


def recall_both_ways(s, d):
    r = _docs(s, d).select((N() % 20).alias("query_id"), F.floor(N() / 20).alias("rank"), F.floor(N() / 60).alias("page"))
    gold = _docs(s, d).where("doc_id % 3 = 0").select((N() % 20).alias("query_id"), F.floor(N() / 60).alias("page"))
    out = audit.recall_both_ways(r, gold, 4)
    return out.select("query_id", F.round("pages_first", 6).alias("pages_first"), F.round("chunks_first", 6).alias("chunks_first"))


def _arms(s, d):
    e = table(s, d, "events")
    arm = lambda k: e.select(F.col("event_id").alias("query_id"), F.col("event_type").alias("category"), (F.col("event_id") * k % 101 / 100.0).alias("score"))
    return arm(7), arm(13)


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def selective_gate(s, d):
    return _r(audit.selective_gate(*_arms(s, d)), "base", "other", "delta", "noise")


def policy_means(s, d):
    return _r(audit.policies(*_arms(s, d)), "base", "other", "by_category", "by_query")


def arm_flips(s, d):
    return audit.flips(*_arms(s, d))


def noise_floor(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 5).alias("run"), F.col("event_type").alias("metric"), "value")
    return _r(audit.noise_floor(e), "spread")


def human_verdicts(s, d):
    v = table(s, d, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "gold_wrong").when(F.col("quality") == 1, "correct").when(N() % 2 == 0, "wrong").otherwise("unsure").alias("verdict"))
    return audit.adjusted(_docs(s, d).select(N().alias("query_id"), (N() % 10 / 10.0).alias("score")), v)


def label_probe(s, d):
    rows = _docs(s, d).select("doc_id", F.when(N() % 9 != 0, F.col("source")).alias("label"))
    return audit.one_of_each(rows, "label", "doc_id").select("doc_id")


def note_format(s, d):
    note = F.when(N() % 3 == 0, F.concat(F.lit("src=x | answer_format="), "lang", F.lit(" | y"))).when(N() % 3 == 1, "nothing")
    return _docs(s, d).select("doc_id", audit.format_of(note).alias("format"))


def figure_injection(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("see Figure "), (F.col("item_id") % 5).cast("string"), F.lit(", table "), (F.col("item_id") % 4).cast("string"), F.lit(" and fig. 2")).alias("text"))
    top = _docs(s, d).select((N() % 40).alias("query_id"), (N() % 20).alias("paper"), F.floor(N() / 40).alias("rank"))
    figs = _docs(s, d).select(N().alias("figure_id"), (N() % 20).alias("paper"), F.when(N() % 2 == 0, "figure").otherwise("table").alias("kind"), (N() % 5).cast("string").alias("n"))
    return audit.injected_figures(q, top, figs)


def order_priorities(s, d):
    """Semi join and conditional counts over the star schema."""
    late = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def pricing_summary(s, d):
    """One pass of grouped sums over the star schema."""
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


_E = "WITH a AS (SELECT event_id AS q, event_type AS category, (event_id * 7 % 101 / 100.0)::DOUBLE AS b, (event_id * 13 % 101 / 100.0)::DOUBLE AS o FROM events)"
_EVID = "CASE doc_id % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'out_of_corpus' WHEN 3 THEN 'factual' WHEN 4 THEN 'out_of_corpus' ELSE 'figure' END"

ORACLES = {
    "facts_in_text": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9%]+', ' ', 'g')) AS nt, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE lang = 'en'),
f AS (SELECT doc_id, nt, trim(regexp_replace(lower(CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:3], ' ') WHEN 1 THEN w[1] || ' qqqq zzzz' WHEN 2 THEN 'the of' ELSE '!!' END), '[^a-z0-9%]+', ' ', 'g')) AS nf FROM t),
c AS (SELECT *, list_filter(string_split(nf, ' '), lambda x: length(x) > 1 AND NOT list_contains(['the','a','an','of','to','in','on','for','and','or','is','are','was','were','be','by','with','at','as','it','its','this','that','these','those','from','what','which','who','whom','how','many','much','does','do','did','page','according','shown','show','figure','table','chart','based','given','following','value','values','number'], x)) AS fw FROM f)
SELECT doc_id, CASE WHEN nf = '' THEN false WHEN contains(nt, nf) THEN true ELSE len(fw) > 0 AND len(list_filter(fw, lambda x: contains(nt, x))) >= 0.8 * len(fw) END AS found FROM c""",
    "tokens_present": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 7 = 3 AND false WHEN 1 THEN false ELSE true END AS found FROM documents",
    "extraction_recall": "SELECT coalesce(lang, 'ALL') AS category, count(*) FILTER (s = 'full') AS \"full\", count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'none') AS none FROM (SELECT lang, CASE doc_id % 3 WHEN 1 THEN 'full' WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'partial' END ELSE 'none' END AS s FROM documents) GROUP BY ROLLUP (lang)",
    "evidence_categories": f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'out_of_corpus' ELSE {_EVID} END AS category, CASE doc_id % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN 'table' WHEN 2 THEN 'ooc' WHEN 3 THEN 'text' WHEN 4 THEN 'ooc' ELSE 'figure' END AS bucket FROM documents",
    "gold_pages": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 9)::VARCHAR WHEN doc_id % 5 = doc_id % 3 THEN (doc_id % 5)::VARCHAR ELSE (doc_id % 5) || ',' || (doc_id % 3) END AS pages FROM documents",
    "label_check": "SELECT doc_id AS query_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 > 0 AND (doc_id % 2 > 0 OR doc_id % 7 % 2 > 0) AS accepted FROM documents",
    "parsed_rewrites": "SELECT doc_id, 'What is ' || source || '?|other ' || lang || '|third ' || lang AS found FROM documents",
    "parsed_subqueries": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source ELSE 'find ' || source || CASE WHEN length(lang) >= 3 THEN '|' || lang ELSE '' END END AS found FROM documents",
    "caption_split": "SELECT doc_id, 'Table of ' || source AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '| a | b |' || chr(10) || '| 1 | 2 |' END AS data FROM documents",
    "reference_spans": """WITH c AS (SELECT doc_id % 20 AS paper, doc_id // 20 AS idx, count(*) OVER (PARTITION BY doc_id % 20) AS n FROM documents),
s AS (SELECT paper, n, min(idx) AS start FROM c WHERE idx % 10 = 7 AND idx >= n // 2 GROUP BY ALL)
SELECT s.paper, s.start, coalesce(min(c.idx), s.n) AS "end" FROM s LEFT JOIN c ON c.paper = s.paper AND c.idx > s.start AND c.idx % 10 = 9 GROUP BY s.paper, s.start, s.n""",
    "recall_both_ways": """WITH f AS (SELECT doc_id % 20 AS q, doc_id // 60 AS page, min(doc_id // 20) AS rank FROM documents GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS place FROM f),
g AS (SELECT DISTINCT doc_id % 20 AS q, doc_id // 60 AS page FROM documents WHERE doc_id % 3 = 0)
SELECT g.q AS query_id, round(count(*) FILTER (place < 4) / count(*), 6) AS pages_first, round(count(*) FILTER (rank < 4) / count(*), 6) AS chunks_first FROM g LEFT JOIN p ON p.q = g.q AND p.page = g.page GROUP BY 1""",
    "selective_gate": f"{_E} SELECT category, count(*) AS n, round(avg(b), 6) AS base, round(avg(o), 6) AS other, round(avg(o) - avg(b), 6) AS delta, round(0.05 * sqrt(40 / count(*)), 6) AS noise, avg(o) >= avg(b) AS gate_on FROM a GROUP BY 1",
    "policy_means": f"{_E}, c AS (SELECT category, count(*) AS n, sum(b) AS b, sum(o) AS o, sum(greatest(b, o)) AS best FROM a GROUP BY 1) SELECT round(sum(b) / sum(n), 6) AS base, round(sum(o) / sum(n), 6) AS other, round(sum(greatest(b, o)) / sum(n), 6) AS by_category, round(sum(best) / sum(n), 6) AS by_query FROM c",
    "arm_flips": f"{_E} SELECT category, count(*) FILTER (o >= 0.5 AND b < 0.5) AS won, count(*) FILTER (b >= 0.5 AND o < 0.5) AS lost FROM a GROUP BY 1",
    "noise_floor": "SELECT event_type AS metric, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1",
    "human_verdicts": "SELECT d.doc_id AS query_id, CASE WHEN quality = 1 THEN 1.0 WHEN quality IS NOT NULL AND d.doc_id % 2 = 0 THEN 0.0 ELSE d.doc_id % 10 / 10.0 END::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1",
    "label_probe": "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT min(doc_id) FROM documents WHERE doc_id % 9 <> 0 GROUP BY source",
    "note_format": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'Str' END AS format FROM documents",
    "figure_injection": """WITH r AS (SELECT item_id AS q, 0 AS ref, 'table' AS kind, item_id % 4 AS n FROM benchmark UNION ALL SELECT item_id, 1, 'figure', item_id % 5 FROM benchmark UNION ALL SELECT item_id, 2, 'figure', 2 FROM benchmark WHERE item_id % 5 <> 2),
p AS (SELECT * FROM (SELECT q, paper, row_number() OVER (PARTITION BY q ORDER BY rank) AS p FROM (SELECT doc_id % 40 AS q, doc_id % 20 AS paper, min(doc_id // 40) AS rank FROM documents GROUP BY ALL)) WHERE p <= 3),
f AS (SELECT r.q, ref, arg_min(doc_id, p * 1000000000000 + doc_id) AS fig FROM r JOIN p ON p.q = r.q JOIN documents d ON doc_id % 20 = paper AND doc_id % 5 = n AND (kind = 'figure') = (doc_id % 2 = 0) GROUP BY ALL)
SELECT q AS query_id, fig AS figure_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ref) AS i FROM f) WHERE i <= 2""",
    "order_priorities": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
}

QUERIES = {name: globals()[name] for name in ORACLES}
