"""Registered retrieval queries: BM25, vectors, fusion, routing, context, lexical tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, context, fusion, lexical, routing, vectors
from ..sources.readers import table

K = 10


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source", "lang")


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(s: SparkSession, d: str, k: int = K, keep=None) -> DataFrame:
    """BM25 hits of the benchmark passages, rank from 0."""
    return bm25.search(_docs(s, d), _asked(s, d), k, keep).withColumn("rank", F.col("rank") - 1)


def _dense(s: SparkSession, d: str, k: int) -> DataFrame:
    """Cosine hits; the vector of a passage is the one with its number."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = _asked(s, d).join(e.select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec")), "query_id").select("query_id", "qvec")
    return vectors.cosine_topk(e, q, k).withColumn("rank", F.col("rank") - 1)


def bm25_topk(s, d):
    return bm25.search(_docs(s, d), _asked(s, d), K).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_filtered(s, d):
    return bm25.search(_docs(s, d), _asked(s, d), 5, F.col("lang") == "en").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_padded(s, d):
    docs, q = _docs(s, d), _asked(s, d)
    out = bm25.pad_with_unmatched(bm25.search(docs, q, K), docs, q, K)
    return out.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0).alias("not_negative"))


def term_stats(s, d):
    return bm25.term_stats(_docs(s, d)).select("term", "df", "cf")


def bm25_within_source(s, d):
    q = _asked(s, d).withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return bm25.within_group(_docs(s, d), q, "source").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def cosine_topk(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    q = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    return vectors.cosine_topk(e, q, 5, exclude_self=True).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def cosine_filtered(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    q = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"), F.col("label").alias("want"))
    return vectors.cosine_topk(e, q, 5, keep=F.col("label") == F.col("want")).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def maxsim_pages(s, d):
    e = table(s, d, "embeddings").withColumn("page", F.floor(F.col("vec_id") / 10))
    tok = e.where("page % 20 = 0").select(F.col("page").alias("query_id"), (F.col("vec_id") % 10).alias("tok"), F.col("embedding").alias("qvec"))
    pages = e.select(F.col("page").alias("doc_id"), F.col("embedding").alias("vec"))
    return vectors.maxsim(pages, tok, 5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def _legs(s, d):
    legs = _hits(s, d, 50).select("query_id", F.lit(0).alias("leg"), F.col("doc_id").alias("id"), "rank")
    return legs.union(_dense(s, d, 50).select("query_id", F.lit(1), "doc_id", "rank"))


def rrf_hybrid(s, d):
    return fusion.rrf(_legs(s, d), top=10).select("query_id", "id", "rank", F.round("score", 8).alias("score"))


def _page_legs(s, d):
    text = _hits(s, d, 20).select("query_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.floor(F.col("doc_id") / 5).alias("page"), F.round("score", 6).alias("score"), "rank")
    seen = _dense(s, d, 20).select("query_id", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), F.floor(F.col("doc_id") / 5).alias("page"), F.round("score", 5).alias("score"), "rank")
    return text, seen


def weighted_page_rrf(s, d):
    out = fusion.weighted_page_rrf(*_page_legs(s, d), weight=2.0)
    return out.select("query_id", "page", "id", "source", "rank", F.round("fused", 8).alias("fused"))


def weight_sweep(s, d):
    text, seen = _page_legs(s, d)
    out = None
    for w in (1, 3, 6):
        part = fusion.weighted_page_rrf(text, seen, weight=float(w)).groupBy("source").agg(F.count("*").alias("n")).select(F.lit(w).alias("weight"), "source", "n")
        out = part if out is None else out.union(part)
    return out


def first_pages(s, d):
    text, _ = _page_legs(s, d)
    return fusion.first_pages(text).select("query_id", "page", "rank")


def _turns(s, d):
    return table(s, d, "conversations").where("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text", F.when(F.col("conv_id") % 7 == 0, "hybrid").when(F.col("conv_id") % 11 == 0, "text").alias("force_route"))


def classify_queries(s, d):
    return routing.dispatch(_turns(s, d)).select("query_id", "category", "path", "forced")


def route_mix(s, d):
    cat = routing.category(F.col("text"))
    return table(s, d, "documents").select(cat.alias("category"), routing.path(cat).alias("path")).groupBy("category", "path").agg(F.count("*").alias("n"))


def cascade_dispatch(s, d):
    q = _asked(s, d).withColumn("force_route", F.when(F.col("query_id") % 9 == 0, "hybrid").when(F.col("query_id") % 10 == 0, "text"))
    out = routing.cascade(q.select("query_id", "force_route"), _hits(s, d), threshold=60.0)
    return out.select("query_id", F.round("top_score", 6).alias("top_score"), "decision")


def visual_fallback(s, d):
    text, seen = _page_legs(s, d)
    fused = fusion.weighted_page_rrf(text, seen).where("query_id % 2 = 0").select("query_id", "id")
    return routing.visual_or_text(text.select("query_id", "id"), fused).groupBy("query_id").agg(F.count("*").alias("n"))


def page_budget_route(s, d):
    pages = _docs(s, d).select(F.col("source").alias("paper"), F.col("doc_id").alias("page_number"))
    q = _asked(s, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("paper"))
    top = _hits(s, d, 5).select("query_id", F.col("doc_id").alias("page_number"))
    return routing.route_by_fit(q, pages, top, 50).select("query_id", "page_number", "whole")


def _labelled(s, d):
    """Chunks that open like captions: ten results for each query."""
    kind = F.when(F.col("doc_id") % 3 == 0, "Figure").otherwise("Table")
    return _docs(s, d).select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper"), (1.0 / (F.col("doc_id") % 10 + 1)).alias("score"), (F.col("doc_id") % 10).alias("rank"), F.concat(kind, F.lit(" "), (F.col("doc_id") % 7).cast("string"), F.lit(": see Table "), (F.col("doc_id") % 5).cast("string"), F.lit(" and Figure "), (F.col("doc_id") % 4).cast("string")).alias("text"))


def region_boost(s, d):
    rows = _labelled(s, d)
    q = rows.select("query_id").distinct().withColumn("text", F.concat(F.lit("what do table "), (F.col("query_id") % 7).cast("string"), F.lit(" and Figure "), (F.col("query_id") % 5).cast("string"), F.lit(" show")))
    return context.region_boost(rows, q).select("query_id", "chunk_id", "matched", "rank")


def linked_artefacts(s, d):
    rows = _labelled(s, d)
    return context.linked(rows.withColumn("paper", F.col("query_id")), rows.withColumn("paper", F.col("query_id"))).select("query_id", "chunk_id", "anchor_id")


def context_expansion(s, d):
    chunks = _docs(s, d).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 20).alias("paper"), F.floor(F.col("doc_id") / 100).alias("page"), F.floor((F.col("doc_id") % 100) / 20).alias("idx"))
    hits = _hits(s, d, 5).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")
    return context.expand(hits, chunks).select("query_id", "chunk_id", "expanded", "rank", F.round("score", 6).alias("score"))


def context_pack(s, d):
    hits = _hits(s, d).join(_docs(s, d).select("doc_id", "text"), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.array(F.col("doc_id") % 7, F.col("doc_id") % 7 + 1).alias("page_numbers"), "text")
    return context.pack(hits, 6000).select("query_id", "chunk_id", "rank", "used")


def rerank_penalty(s, d):
    hits = _hits(s, d).join(_docs(s, d).select("doc_id", "text"), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "rank", "text")
    return context.rerank(hits, (F.length("text") % 97) / F.lit(97.0), 5).select("query_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


def refusal_gate(s, d):
    return context.refuse(_asked(s, d), _hits(s, d), 100.0)


def citations_extract(s, d):
    n = F.col("doc_id")
    answers = _docs(s, d).select(n.alias("query_id"), F.concat(F.lit("By ["), (n + 2).cast("string"), F.lit("] and [chunk_id "), (n + 1).cast("string"), F.lit("], also ["), (n + 2).cast("string"), F.lit("] [see x]")).alias("answer"))
    used = _docs(s, d).select(n.alias("query_id"), F.explode(F.array(*[(n + i).cast("string") for i in range(3)])).alias("chunk_id")).where("chunk_id % 3 <> 0")
    return context.cited(answers, used)


def decoration_filter(s, d):
    chunks = _docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 == 0, "decoration").when(F.col("doc_id") % 4 == 1, "figure").alias("role"))
    hits = _hits(s, d).select("query_id", F.col("doc_id").alias("chunk_id"), "rank")
    return context.without_decoration(hits, chunks).select("query_id", "chunk_id", "rank")


def lex_search(s, d):
    return lexical.search(_docs(s, d), "the haenble ing").select("doc_id", "score")


def lex_filter_all(s, d):
    return lexical.filter_all(_docs(s, d), ["the", "ing", "eder"]).select("doc_id", "score")


def lex_count(s, d):
    return lexical.count(_docs(s, d), ["the", "ing", "a", "zzzz", "tion"])


def lex_grep(s, d):
    return lexical.grep(_docs(s, d), r"\bthe\b.*\bing", 50).select("doc_id", "line", "text")


def lex_read(s, d):
    return lexical.read(_docs(s, d), 2, 4)


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BM25 = f"""toks AS (SELECT doc_id, source, lang, {_WORDS} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
posts AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), corpus),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idf USING (term) JOIN posts USING (term) GROUP BY ALL)"""


def _top(k: int, where: str = "true") -> str:
    return f"hits AS (SELECT * FROM (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.doc_id) - 1 AS rank FROM scored s JOIN documents d ON d.doc_id = s.doc_id WHERE {where}) WHERE rank < {k})"


_UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_DENSE = f"dense AS (SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, {_UNIT} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_UNIT}, 9) DESC, a.vec_id) - 1 AS rank FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)) WHERE rank < %d)"
_PAGES = f"""WITH {_BM25}, {_top(20)}, {_DENSE % 20},
t AS (SELECT query_id, 'c' || doc_id AS id, doc_id // 5 AS page, round(score, 6) AS score, rank FROM hits),
v AS (SELECT query_id, 'v' || doc_id AS id, doc_id // 5 AS page, round(score, 5) AS score, rank FROM dense),
tp AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) - 1 AS rank FROM t GROUP BY query_id, page)"""


def _fused(w: int, top: int = 10) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, leg0, rank0) - 1 AS rank FROM (
SELECT query_id, page, sum(gain) AS fused, min(leg) AS leg0, arg_min(rank, leg * 1000 + rank) AS rank0 FROM (
SELECT query_id, page, 0 AS leg, rank, 1.0 / (61 + rank) AS gain FROM tp UNION ALL SELECT query_id, page, 1, rank, {w}.0 / (61 + rank) FROM v) GROUP BY query_id, page)) WHERE rank < {top}"""


_BEST = "(SELECT query_id, page, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY {}) AS n FROM {}) WHERE n = 1)"
_CATEGORY = r"""CASE WHEN regexp_matches(text, '(?i)\btable\s+\d+|\bcell\b|\brow\b|\bcolumn\b') THEN 'table'
WHEN regexp_matches(text, '(?i)\bfigure\s+\d+|\bfig\.\s*\d+|\bplot\b|\bdiagram\b|\bchart\b|\bgraphs?\b') THEN 'figure'
WHEN regexp_matches(text, '(?i)\bcompare\b|\bvs\.?\b|\bversus\b|\bdifferences?\b|\bbetween\b') THEN 'multi_hop'
WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])(\d+(\.\d+)?|[A-Z]{2,})([^\p{L}\p{N}_]|$)') THEN 'factual' ELSE 'definitional' END"""
_LAB = """lab AS (SELECT doc_id // 10 AS query_id, doc_id AS chunk_id, doc_id % 10 AS rank, CASE WHEN doc_id % 3 = 0 THEN 'figure' ELSE 'table' END AS kind, doc_id % 7 AS n, doc_id % 5 AS says_t, doc_id % 4 AS says_f FROM documents)"""
_SEARCHED = "the|haenble|ing"

ORACLES = {
    "bm25_topk": f"WITH {_BM25}, {_top(10)} SELECT query_id, doc_id, rank + 1 AS rank, round(score, 6) AS score FROM hits",
    "bm25_filtered": f"WITH {_BM25}, {_top(5, chr(39).join(['d.lang = ', 'en', '']))} SELECT query_id, doc_id, rank + 1 AS rank, round(score, 6) AS score FROM hits",
    "bm25_padded": "SELECT item_id AS query_id, 10::BIGINT AS n, 10::BIGINT AS not_negative FROM benchmark",
    "term_stats": f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term",
    "bm25_within_source": f"""WITH toks AS (SELECT doc_id, source, {_WORDS} AS t FROM documents),
corpus AS (SELECT source, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY source),
posts AS (SELECT doc_id, source, dl, term, count(*) AS tf FROM (SELECT doc_id, source, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT source, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT source, term, count(*) AS df FROM posts GROUP BY ALL) JOIN corpus USING (source)),
idf AS (SELECT source, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY source) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, unnest({_WORDS}) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idf USING (source, term) JOIN posts USING (source, term) GROUP BY ALL)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""",
    "cosine_topk": f"SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_UNIT}, 9) DESC, a.vec_id) AS rank, round({_UNIT}, 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5",
    "cosine_filtered": f"SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_UNIT}, 9) DESC, a.vec_id) AS rank, round({_UNIT}, 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.label = b.label) WHERE rank <= 5",
    "maxsim_pages": """WITH m AS (SELECT q.vec_id // 10 AS query_id, p.vec_id // 10 AS doc_id, q.vec_id AS tok, max(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])) AS m FROM embeddings q, embeddings p WHERE q.vec_id // 10 % 20 = 0 GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(m) AS score FROM m GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, round(score, 4) AS score FROM s) WHERE rank <= 5""",
    "rrf_hybrid": f"""WITH {_BM25}, {_top(50)}, {_DENSE % 50},
l AS (SELECT query_id, doc_id AS id, 0 AS leg, rank FROM hits UNION ALL SELECT query_id, doc_id, 1, rank FROM dense),
f AS (SELECT query_id, id, sum(1.0 / (61 + rank)) AS score, min(leg * 1000 + rank) AS first FROM l GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) - 1 AS rank, round(score, 8) AS score FROM f) WHERE rank < 10""",
    "weighted_page_rrf": f"""{_PAGES}, f AS ({_fused(2)})
SELECT f.query_id, f.page, coalesce(bt.id, bv.id) AS id, CASE WHEN bt.id IS NOT NULL THEN 'pipeline' ELSE 'visual' END AS source, f.rank, round(f.fused, 8) AS fused
FROM f LEFT JOIN {_BEST.format("score DESC, rank", "t")} bt ON bt.query_id = f.query_id AND bt.page = f.page LEFT JOIN {_BEST.format("rank DESC", "v")} bv ON bv.query_id = f.query_id AND bv.page = f.page""",
    "weight_sweep": f"{_PAGES} " + " UNION ALL ".join(f"SELECT {w}::BIGINT AS weight, CASE WHEN f.query_id IN (SELECT query_id FROM tp WHERE tp.page = f.page) THEN 'pipeline' ELSE 'visual' END AS source, count(*) AS n FROM ({_fused(w)}) f GROUP BY ALL" for w in (1, 3, 6)),
    "first_pages": f"{_PAGES} SELECT query_id, page, rank FROM tp",
    "classify_queries": f"""WITH c AS (SELECT conv_id || '-' || turn AS query_id, {_CATEGORY} AS category, CASE WHEN conv_id % 7 = 0 THEN 'hybrid' WHEN conv_id % 11 = 0 THEN 'text' END AS f FROM conversations WHERE role = 'user')
SELECT query_id, category, coalesce(f, CASE WHEN category IN ('figure', 'table', 'multi_hop') THEN 'hybrid' ELSE 'text' END) AS path, f IS NOT NULL AS forced FROM c""",
    "route_mix": f"SELECT category, CASE WHEN category IN ('figure', 'table', 'multi_hop') THEN 'hybrid' ELSE 'text' END AS path, count(*) AS n FROM (SELECT {_CATEGORY} AS category FROM documents) GROUP BY ALL",
    "cascade_dispatch": f"""WITH {_BM25}, {_top(10)}, q AS (SELECT item_id AS query_id, CASE WHEN item_id % 9 = 0 THEN 'hybrid' WHEN item_id % 10 = 0 THEN 'text' END AS f FROM benchmark),
t AS (SELECT q.query_id, f, coalesce(score, 0) AS s FROM q LEFT JOIN hits ON hits.query_id = q.query_id AND rank = 0)
SELECT query_id, round(CASE WHEN f = 'hybrid' THEN 0 ELSE s END, 6) AS top_score, CASE WHEN f IS NOT NULL THEN 'forced_' || f WHEN s >= 60 THEN 'confident_text' ELSE 'uncertain_hybrid' END AS decision FROM t""",
    "visual_fallback": f"{_PAGES}, f AS ({_fused(1)}) SELECT query_id, count(*) AS n FROM f WHERE query_id % 2 = 0 GROUP BY 1 UNION ALL SELECT query_id, count(*) FROM t WHERE query_id NOT IN (SELECT query_id FROM f WHERE query_id % 2 = 0) GROUP BY 1",
    "page_budget_route": f"""WITH {_BM25}, {_top(5)}, n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source FROM benchmark)
SELECT query_id, doc_id AS page_number, true AS whole FROM q JOIN n USING (source) JOIN documents USING (source) WHERE n <= 50
UNION ALL SELECT query_id, doc_id, false FROM q JOIN n USING (source) JOIN hits USING (query_id) WHERE n > 50""",
    "region_boost": f"""WITH {_LAB}, m AS (SELECT *, CASE WHEN kind = 'table' THEN n = query_id % 7 ELSE n = query_id % 5 END AS matched FROM lab)
SELECT query_id, chunk_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, rank) - 1 AS rank FROM m""",
    "linked_artefacts": f"""WITH {_LAB}, r AS (SELECT query_id, chunk_id AS anchor_id, kind, n FROM lab UNION SELECT query_id, chunk_id, 'table', says_t FROM lab UNION SELECT query_id, chunk_id, 'figure', says_f FROM lab)
SELECT DISTINCT r.query_id, l.chunk_id, r.anchor_id FROM r JOIN lab l USING (query_id, kind, n) WHERE l.chunk_id <> r.anchor_id""",
    "context_expansion": f"""WITH {_BM25}, {_top(5)}, c AS (SELECT doc_id, doc_id % 20 AS paper, doc_id // 100 AS page, (doc_id % 100) // 20 AS idx FROM documents),
a AS (SELECT query_id, doc_id, score, rank, paper, page, idx FROM hits JOIN c USING (doc_id)),
e AS (SELECT query_id, doc_id, score, 0 AS kind, rank AS anchor, 0 AS step FROM a UNION ALL SELECT a.query_id, c.doc_id, a.score * 0.5, 1, a.rank, CASE WHEN c.idx < a.idx THEN 0 ELSE 1 END FROM a JOIN c ON c.paper = a.paper AND c.page = a.page AND abs(c.idx - a.idx) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY kind, anchor, step) AS n FROM e)
SELECT query_id, doc_id AS chunk_id, kind = 1 AS expanded, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, anchor, step) - 1 AS rank, sum(kind) OVER (PARTITION BY query_id ORDER BY kind, anchor, step) AS added FROM f WHERE n = 1) WHERE added <= 12""",
    "context_pack": f"""WITH {_BM25}, {_top(10)}, r AS (SELECT query_id, doc_id AS chunk_id, rank, sum(length('[' || doc_id || '] (pages ' || doc_id % 7 || ', ' || doc_id % 7 + 1 || ') ' || text) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 AS used FROM hits JOIN documents USING (doc_id)),
o AS (SELECT *, max(CASE WHEN used > 6000 AND rank > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM r)
SELECT query_id, chunk_id, rank, used::BIGINT AS used FROM o WHERE over = 0""",
    "rerank_penalty": f"""WITH {_BM25}, {_top(10)}, r AS (SELECT query_id, doc_id AS chunk_id, rank AS r0, (length(text) % 97) / 97.0 - CASE WHEN length(text) < 300 THEN 0.5 * (1 - length(text) / 300.0) ELSE 0 END AS s FROM hits JOIN documents USING (doc_id))
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s::DOUBLE, 9) DESC, r0) - 1 AS rank, round(s::DOUBLE, 6) AS rerank_score FROM r) WHERE rank < 5""",
    "refusal_gate": f"WITH {_BM25}, {_top(10)} SELECT item_id AS query_id, coalesce(max(score) < 100, true) AS refused FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY 1",
    "citations_extract": """WITH c AS (SELECT doc_id AS query_id, unnest([doc_id + 2, doc_id + 1]) AS c, unnest([1, 2]) AS p FROM documents)
SELECT query_id, c::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS number FROM c WHERE c % 3 <> 0""",
    "decoration_filter": f"WITH {_BM25}, {_top(10)} SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM hits WHERE doc_id % 4 <> 0",
    "lex_search": f"SELECT doc_id, len(regexp_extract_all(lower(text), '{_SEARCHED}'))::BIGINT AS score FROM documents ORDER BY score DESC, doc_id DESC LIMIT 10",
    "lex_filter_all": "SELECT doc_id, (a + b + c)::BIGINT AS score FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS a, len(regexp_extract_all(lower(text), 'ing')) AS b, len(regexp_extract_all(lower(text), 'eder')) AS c FROM documents) WHERE least(a, b, c) > 0 ORDER BY score DESC, doc_id DESC LIMIT 10",
    "lex_count": "SELECT term, count(*) FILTER (n > 0) AS docs, coalesce(sum(n), 0)::BIGINT AS occurrences FROM (SELECT term, CASE WHEN length(term) > 1 THEN len(regexp_extract_all(lower(text), term)) ELSE 0 END AS n FROM documents, (VALUES ('the'), ('ing'), ('a'), ('zzzz'), ('tion')) v(term)) GROUP BY term",
    "lex_grep": r"""SELECT * FROM (SELECT doc_id, line, substr(trim(ln), 1, 300) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) WHERE regexp_matches(ln, '(?i)\bthe\b.*\bing') ORDER BY doc_id, line LIMIT 50)""",
    "lex_read": "SELECT doc_id, coalesce(array_to_string(list_transform(l, lambda x, i: (i + 1)::VARCHAR || ': ' || x), chr(10)), '') AS view FROM (SELECT doc_id, string_split(text, chr(10))[2:4] AS l FROM documents)",
}

QUERIES = {name: globals()[name] for name in ORACLES}
