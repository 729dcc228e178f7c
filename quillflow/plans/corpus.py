"""Registered corpus queries: ingest, geometry, graph, catalogue and streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, graph, ingest, regions
from ..sources.readers import table
from ..streaming import jobs


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of their source, some with a header line, a page number above and one below."""
    n = F.col("doc_id")
    head = F.when(n % 5 != 0, F.concat(F.lit("Report of "), "source", F.lit("\n"))).otherwise("")
    text = F.concat(head, (n % 97).cast("string"), F.lit("\n\n"), "text", F.lit("\n"), (n % 89).cast("string"), F.lit("\n"))
    return table(s, d, "documents").select(F.col("source").alias("paper"), n.alias("page_number"), text.alias("text"))


def running_header(s, d):
    return ingest.running_headers(_pages(s, d))


def strip_furniture(s, d):
    p = _pages(s, d)
    return ingest.strip_furniture(p, ingest.running_headers(p)).select("page_number", F.length("body").alias("n"), F.md5(F.encode("body", "UTF-8")).alias("digest"))


def page_spans(s, d):
    p = table(s, d, "documents").select(F.col("source").alias("paper"), F.col("doc_id").alias("page_number"), F.col("text").alias("body"))
    return ingest.page_spans(p)


def soup_filter(s, d):
    digits = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[a-z]", "1")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", T.is_soup(digits).alias("soup"))


def junk_share(s, d):
    rows = table(s, d, "documents").select("source", F.length("text").alias("n"), T.is_soup(F.col("text")).alias("junk"))
    out = rows.rollup("source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("junk"), F.col("n")).otherwise(0)).alias("junk"))
    return out.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "total", "junk", F.round(F.col("junk") / F.col("total"), 6).alias("share"))


def _headed(s, d):
    """Documents with three heading lines put in."""
    at = F.regexp_replace("text", r"^([^\n]*)\n", "$1\n1 Introduction\n")
    return table(s, d, "documents").select("doc_id", F.concat(at, F.lit("\nB.2 More Results\nbody\n  REFERENCES: \nlast")).alias("text"))


def headings(s, d):
    return ingest.headings(_headed(s, d), "doc_id").select("doc_id", "start", "title")


def sections(s, d):
    return ingest.sections(_headed(s, d), "doc_id")


def window_chunks(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("body"))
    return ingest.windows(docs).select("doc_id", "w_start", "w_end")


def chunk_pages(s, d):
    return ingest.chunk(_pages(s, d)).select("chunk_id", "paper", "text", "section", F.size("page_numbers").alias("n_pages"))


def ingest_scorecard(s, d):
    c = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("paper"), F.array_repeat(F.lit(1), (1 + F.col("doc_id") % 3).cast("int")).alias("page_numbers"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("section"))
    return ingest.scorecard(c)


def running_prefix(s, d):
    p = table(s, d, "documents").select(F.col("source").alias("paper"), F.col("doc_id").alias("page_number"), F.concat(F.lit("Annual Report "), F.when(F.col("doc_id") % 4 == 0, "One ").otherwise("Two "), "text").alias("text"))
    return ingest.running_prefixes(p)


def indexed_text(s, d):
    c = table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).when(F.col("doc_id") % 3 == 0, "").alias("context"))
    return ingest.contextualize(c).select("doc_id", F.length("indexed_text").alias("n"))


def injected_scorer(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return ingest.scored_by(docs, lambda texts: texts.fillna("").str.len() % 1000 / 1000).select("doc_id", F.round("score", 6).alias("score"))


def _boxes(s, d, name: str, shift: int):
    """A box for each line item, ten orders to a page."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    x0, y0 = ((F.col("p") + shift) % 40 * 10).cast("double"), ((F.col("q") * 7 + shift) % 60 * 10).cast("double")
    return li.select(k.alias(name), F.floor(F.col("l_orderkey") / 10).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 30 + F.col("l_linenumber") * 20).alias("x1"), (y0 + 20 + F.col("p") % 9 * 10).alias("y1"))


def bbox_outside(s, d):
    return regions.outside(_boxes(s, d, "block_id", 0), _boxes(s, d, "region_id", 1)).select("block_id")


def bbox_union(s, d):
    return regions.union_boxes(_boxes(s, d, "box_id", 0), ["page"])


def bbox_largest(s, d):
    return regions.largest(_boxes(s, d, "box_id", 0), ["page"])


def bbox_flip(s, d):
    b = _boxes(s, d, "box_id", 0).withColumn("page_height", F.when(F.col("page") % 3 != 0, F.lit(500.0)))
    return regions.flip(b).select("box_id", "x0", "y0", "x1", "y1")


def caption_nearest(s, d):
    return regions.nearest_captions(_boxes(s, d, "image_id", 0), _boxes(s, d, "caption_id", 13))


def caption_recover(s, d):
    return regions.recover_captions(_boxes(s, d, "image_id", 0), _boxes(s, d, "text_id", 13))


def figure_roles(s, d):
    labels = s.createDataFrame([("logo", "decoration"), ("chart", "figure"), ("icon", "decoration")], "label string, role string")
    k = F.col("box_id")
    f = _boxes(s, d, "box_id", 0).select("*", F.when(k % 7 == 0, "Figure 3: x").alias("caption"), F.when(k % 5 == 0, "logo").when(k % 5 == 1, "chart").when(k % 5 == 2, "icon").alias("label"), (k % 10 / 10.0).alias("confidence"))
    return regions.role(f, labels).select("box_id", "role")


def table_markdown(s, d):
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("cells"))
    return n.select("n_regionkey", regions.table_markdown(F.concat(F.array(F.array(F.lit("name"))), "cells")).alias("md"))


def _extracted(s, d):
    """Entities and relations: the first words of the chunks."""
    w = F.split(T.collapse(F.col("text")), " ")
    docs = table(s, d, "documents").select("doc_id", F.slice(w, 1, 4).alias("w"), "lang", "source", (F.col("doc_id") % 13 == 0).alias("is_reference_list"))
    ents = docs.select(F.col("doc_id").alias("chunk_ix"), F.col("doc_id").cast("string").alias("chunk_id"), F.posexplode("w").alias("ent_ix", "name"), F.when(F.col("doc_id") % 2 == 0, "method").otherwise("dataset").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("description"), "is_reference_list")
    rels = docs.where(F.size("w") >= 3).select(F.col("doc_id").alias("chunk_ix"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("rel_ix"), F.get("w", F.lit(0)).alias("source"), F.get("w", F.lit(2)).alias("target"), F.col("lang").alias("description"), (F.col("doc_id") % 4 + 1).cast("double").alias("weight"), "is_reference_list")
    return ents, rels


def graph_nodes(s, d):
    n = graph.nodes(*_extracted(s, d))
    return n.select("node", "display", "type", F.array_join("descriptions", "|").alias("descriptions"), F.array_join("chunk_ids", "|").alias("chunk_ids"))


def graph_edges(s, d):
    e = graph.edges(_extracted(s, d)[1])
    return e.select("a", "b", "weight", F.array_join("descriptions", "|").alias("descriptions"), F.array_join("chunk_ids", "|").alias("chunk_ids"))


def graph_metrics(s, d):
    ents, rels = _extracted(s, d)
    out = graph.metrics(graph.nodes(ents, rels), graph.edges(rels), 100)
    return out.select("nodes", "edges", F.round("isolated", 6).alias("isolated"), F.round("entities_per_chunk", 6).alias("entities_per_chunk"))


def graph_communities(s, d):
    ents, rels = _extracted(s, d)
    return graph.communities(graph.nodes(ents, rels), graph.edges(rels))


def graph_context(s, d):
    ents, rels = _extracted(s, d)
    nodes, edges = graph.nodes(ents, rels), graph.edges(rels)
    return graph.community_context(nodes.select("node", F.substring("node", 1, 1).alias("community")), nodes, edges).select("community", F.length("context").alias("n"))


def graph_parse(s, d):
    answer = F.concat(F.lit('Sure:\n```json\n{"is_reference_list": '), (F.col("doc_id") % 5 == 0).cast("string"), F.lit(', "entities": [{"name": "'), F.col("source"), F.lit('", "type": "method"}, {"name": " "}], "relations": [{"source": "a", "target": "b", "weight": '), (F.col("doc_id") % 30 - 5).cast("string"), F.lit("}]}\n```"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 7 == 0, "no json here").otherwise(answer).alias("answer"))
    p = graph.parse_extraction(docs)
    return p.select("chunk_id", "is_reference_list", F.size("entities").alias("n_entities"), F.get("relations", F.lit(0))["weight"].alias("weight"))


def gallery(s, d):
    n = F.col("doc_id")
    items = table(s, d, "documents").select(F.col("source").alias("paper"), (n % 9).alias("page"), n.alias("chunk_id"), F.when(n % 3 == 0, "figure").when(n % 3 == 1, "table").otherwise("text").alias("kind"), F.when(n % 4 == 0, "decoration").alias("role"), (n % 1000).cast("double").alias("area"))
    return browse.gallery(items).select("paper", "page", "chunk_id")


def catalogue(s, d):
    chunks = table(s, d, "documents").select(F.col("source").alias("paper"), (F.col("doc_id") % 7).alias("page"))
    titles = table(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("paper"), F.col("n_name").alias("title")).where("paper <> 'src3'")
    return browse.papers(chunks, titles)


def client_search(s, d):
    return browse.text_filter(table(s, d, "documents"), "THE ING", ["text", "source"]).select("doc_id")


def upsert_latest(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 500).alias("id"), F.col("event_id").alias("version"), "value")
    return browse.upsert(e.where("version < 5000"), e.where("version >= 5000"), "id", "version")


def append_new(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    return browse.append_new(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0"), ["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def silent_misses(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("paper"), F.lit("figure").alias("kind"), (F.col("o_orderkey") % 10).alias("n"))
    return browse.missing_labels(o, o.where("n % 3 <> 0"))


def common_queries(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("query_id"))
    return browse.common_queries(e)


def excluded_ids(s, d):
    r = table(s, d, "documents").select("source", "doc_id").withColumnsRenamed({"source": "query_id", "doc_id": "id"}).withColumn("rank", F.floor(F.col("id") / 20))
    return browse.without_excluded(r, r.where("id % 5 = 0").select("query_id", "id"))


def stratified_sample(s, d):
    docs = table(s, d, "documents")
    return browse.stratified(docs, "lang", "source", "doc_id", {"en": 30, "de": 20}).select("doc_id", "lang", "source", "place")


def loop_detector(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("action"))
    return browse.repeats_before(e).groupBy("run").agg(F.count_if("repeated").alias("repeats"))


def quota_daily(s, d):
    e = table(s, d, "events").select("ts", F.col("event_id").alias("id"))
    return browse.quota(e, 250).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("used"))


def min_max_scale(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return browse.min_max(e).select("id", F.round("scaled", 6).alias("scaled"))


def chunk_dump(s, d):
    return browse.dump(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def snapshot_diff(s, d):
    o = lambda p: table(s, d, "orders").where(p).agg(F.count("*").alias("n"), F.max("o_custkey").alias("most"), F.lit(7).alias("same"))
    return browse.snapshot_diff(o("o_orderkey % 3 <> 0"), o("true"))


def prompt_version(s, d):
    p = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit("v1").alias("declared"), F.col("text").alias("body"))
    return browse.prompt_version(p)


def judge_parse(s, d):
    a = F.concat(F.lit("\n  Score: "), ((F.col("doc_id") - 50) / 100).cast("string"), F.lit(" because 9"))
    return table(s, d, "documents").select("doc_id", T.judge_score(F.when(F.col("doc_id") % 9 == 0, "none").otherwise(a)).alias("score"))


def _stream(s, d, make, mode="complete"):
    """The result of a streaming job over the events as they are now."""
    name = f"stream_{uuid.uuid4().hex}"
    base = s.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillflow-")
    src = s.readStream.schema(jobs.EVENTS).option("pathGlobFilter", "*.parquet").parquet(_folder(s, d))
    return jobs.run_available(make(src), name, f"{base.rstrip('/')}/{name}", mode)


def _folder(s, d):
    """A folder that holds the events alone: a stream reads folders, not files."""
    base = s.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillflow-")
    path = f"{base.rstrip('/')}/events-{uuid.uuid4().hex}"
    table(s, d, "events").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in jobs.EVENTS.split(", ")]).write.parquet(path)
    return path


def stream_quota(s, d):
    return _stream(s, d, lambda e: jobs.daily_quota(e, 250)).select(F.col("day").cast("string").alias("day"), "used", "allowed")


def stream_rate_limit(s, d):
    return _stream(s, d, lambda e: jobs.rate_limit(e, 1, "1 hour")).select("user_id", F.col("start").cast("string").alias("start"), "used", "refused")


def stream_sessions(s, d):
    below = "5 hours 59 minutes 59 seconds 999 milliseconds 999 microseconds"  # a pause of six hours exactly begins a session
    return _stream(s, d, lambda e: jobs.sessions(e, below)).select("user_id", F.col("start").cast("string").alias("start"), "n")


_P = """p AS (SELECT source AS paper, doc_id AS page_number, CASE WHEN doc_id % 5 <> 0 THEN 'Report of ' || source END AS head, text FROM documents)"""
_H = r"""h AS (SELECT doc_id, regexp_replace(text, '^([^\n]*)\n', E'\\1\n1 Introduction\n') || E'\nB.2 More Results\nbody\n  REFERENCES: \nlast' AS text FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS i FROM h),
st AS (SELECT *, coalesce(sum(length(ln) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ln),
hd AS (SELECT doc_id, start, start + length(ln) + 1 AS body_start, title FROM (SELECT *, CASE
WHEN regexp_matches(ln, '^[ \t]*(\d+(?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$') THEN trim(regexp_replace(regexp_extract(ln, '^[ \t]*(\d+(?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$', 1) || ' ' || regexp_extract(ln, '^[ \t]*(\d+(?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$', 2), '\s+', ' ', 'g'))
WHEN regexp_matches(ln, '^[ \t]*(?:Appendix[ \t]+)?([A-Z](?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$') THEN trim(regexp_replace(regexp_extract(ln, '^[ \t]*(?:Appendix[ \t]+)?([A-Z](?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$', 1) || ' ' || regexp_extract(ln, '^[ \t]*(?:Appendix[ \t]+)?([A-Z](?:\.\d+)*)[ \t]+([A-Z][A-Za-z][A-Za-z\s\-:&]{1,60})[ \t]*$', 2), '\s+', ' ', 'g'))
WHEN regexp_matches(ln, '(?i)^[ \t]*(Abstract|Acknowledge?ments?|Conclusions?|References|Bibliography|Appendix|Supplementary(?:[ \t]+Material)?)[ \t]*:?[ \t]*$') THEN trim(regexp_extract(ln, '(?i)^[ \t]*(Abstract|Acknowledge?ments?|Conclusions?|References|Bibliography|Appendix|Supplementary(?:[ \t]+Material)?)[ \t]*:?[ \t]*$', 1)) END AS title FROM st) WHERE title IS NOT NULL)"""
_SOUP = r"""(length(regexp_replace(x, '\s+', '', 'g')) = 0 OR (NOT (regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(the|and|that|with|this|from|which|where|are)([^\p{L}\p{N}_]|$)') AND len(regexp_extract_all(x, '[A-Za-z]{3,}')) >= 8) AND length(regexp_replace(x, '[^\p{L}]', '', 'g')) < 0.45 * length(regexp_replace(x, '\s+', '', 'g')) AND len(regexp_extract_all(x, '[A-Za-z]{3,}')) < 12))"""


def _box(name: str, shift: int) -> str:
    return f"(SELECT l_orderkey * 10 + l_linenumber AS {name}, l_orderkey // 10 AS page, x0, y0, x0 + 30 + l_linenumber * 20 AS x1, y0 + 20 + p % 9 * 10 AS y1 FROM (SELECT l_orderkey, l_linenumber, p, ((p + {shift}) % 40 * 10)::DOUBLE AS x0, ((q * 7 + {shift}) % 60 * 10)::DOUBLE AS y0 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS q FROM lineitem GROUP BY ALL)))"


_G = r"""dw AS (SELECT doc_id, lang, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:4] AS w FROM documents WHERE NOT doc_id % 13 = 0),
en AS (SELECT doc_id, unnest(w) AS name, unnest(range(len(w))) AS ix, 0 AS part, CASE WHEN doc_id % 2 = 0 THEN 'method' ELSE 'dataset' END AS type, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS d FROM dw),
rl AS (SELECT doc_id, w[1] AS s, w[3] AS t, lang AS d, (doc_id % 4 + 1)::DOUBLE AS weight FROM dw WHERE len(w) >= 3),
mn AS (SELECT *, lower(trim(name)) AS node FROM (SELECT * FROM en UNION ALL SELECT doc_id, s, 1000000, 0, 'concept', '' FROM rl UNION ALL SELECT doc_id, t, 1000000, 1, 'concept', '' FROM rl) WHERE trim(name) <> ''),
ed AS (SELECT least(lower(s), lower(t)) AS a, greatest(lower(s), lower(t)) AS b, weight, d, doc_id FROM rl WHERE lower(s) <> lower(t) AND s <> '' AND t <> '')"""
_NODES = """SELECT n.node, arg_min(name, doc_id * 100000000 + ix * 10 + part) AS display, any_value(k.type) AS type, coalesce(any_value(ds.d), '') AS descriptions, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), '|') AS chunk_ids FROM mn n
JOIN (SELECT node, arg_min(type, -c * 1000000000000000 + f) AS type FROM (SELECT node, type, count(*) AS c, min(doc_id * 100000000 + ix * 10 + part) AS f FROM mn GROUP BY ALL) GROUP BY node) k ON k.node = n.node
LEFT JOIN (SELECT node, string_agg(d, '|' ORDER BY f) AS d FROM (SELECT node, d, min(doc_id * 100000000 + ix * 10 + part) AS f FROM mn WHERE d <> '' GROUP BY ALL) GROUP BY node) ds ON ds.node = n.node GROUP BY n.node"""

ORACLES = {
    "running_header": "SELECT source AS paper, 'Report of ' || source AS header FROM documents GROUP BY source HAVING count(*) >= 3 AND count(*) FILTER (doc_id % 5 <> 0) >= greatest(2, floor(0.6 * count(*)))",
    "strip_furniture": f"""WITH {_P}, hh AS (SELECT paper FROM p GROUP BY paper HAVING count(*) >= 3 AND count(head) >= greatest(2, floor(0.6 * count(*)))),
c AS (SELECT p.page_number, string_split(CASE WHEN head IS NOT NULL AND hh.paper IS NULL THEN head || chr(10) || (page_number % 97) || chr(10) || chr(10) ELSE '' END || text, chr(10)) AS l, hh.paper IS NOT NULL OR head IS NULL AS clean FROM p LEFT JOIN hh USING (paper)),
n AS (SELECT page_number, l, clean, list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '^\\s*$')) AS vis FROM c),
r AS (SELECT page_number, array_to_string(CASE WHEN clean AND len(vis) > 0 THEN l[vis[1]:] WHEN clean THEN [] ELSE l END, chr(10)) AS body FROM n)
SELECT page_number, length(body) AS n, md5(body) AS digest FROM r""",
    "page_spans": "SELECT source AS paper, doc_id AS page_number, s AS start, s + length(text) AS end FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM documents)",
    "soup_filter": f"SELECT doc_id, {_SOUP} AS soup FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[a-z]', '1', 'g') ELSE text END AS x FROM documents)",
    "junk_share": f"SELECT coalesce(source, 'TOTAL') AS source, sum(n)::BIGINT AS total, sum(CASE WHEN junk THEN n ELSE 0 END)::BIGINT AS junk, round(sum(CASE WHEN junk THEN n ELSE 0 END) / sum(n), 6) AS share FROM (SELECT source, length(text) AS n, {_SOUP} AS junk FROM (SELECT source, text, text AS x FROM documents)) GROUP BY ROLLUP (source)",
    "headings": f"WITH {_H} SELECT doc_id, start, title FROM hd",
    "sections": f"""WITH {_H} SELECT hd.doc_id, least(body_start, length(text)) AS start, coalesce(lead(start) OVER (PARTITION BY hd.doc_id ORDER BY start), length(text)) AS end, title FROM hd JOIN h ON h.doc_id = hd.doc_id QUALIFY least(body_start, length(text)) < coalesce(lead(start) OVER (PARTITION BY hd.doc_id ORDER BY start), length(text))
UNION ALL SELECT h.doc_id, 0, coalesce(f, length(text)), NULL FROM h LEFT JOIN (SELECT doc_id, min(start) AS f FROM hd GROUP BY 1) m ON m.doc_id = h.doc_id WHERE regexp_replace(substr(text, 1, coalesce(f, length(text))), '\\s', '', 'g') <> ''""",
    "window_chunks": """WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS s, CASE WHEN length(text) <= 1200 THEN length(text) ELSE e END AS e FROM (SELECT doc_id, text, CASE WHEN greatest(d, n) > 1120 THEN greatest(d, n) + 1 ELSE 1200 END AS e FROM (SELECT doc_id, text, CASE WHEN strpos(reverse(substr(text, 1, 1200)), ' .') = 0 THEN -1 ELSE 1200 - strpos(reverse(substr(text, 1, 1200)), ' .') - 1 END AS d, CASE WHEN strpos(reverse(substr(text, 1, 1200)), chr(10)) = 0 THEN -1 ELSE 1200 - strpos(reverse(substr(text, 1, 1200)), chr(10)) END AS n FROM documents WHERE text <> ''))
UNION ALL SELECT doc_id, text, s2, CASE WHEN s2 + 1200 >= length(text) THEN length(text) WHEN greatest(d, n) > 1120 THEN s2 + greatest(d, n) + 1 ELSE s2 + 1200 END FROM (SELECT doc_id, text, s2, CASE WHEN strpos(reverse(x), ' .') = 0 THEN -1 ELSE length(x) - strpos(reverse(x), ' .') - 1 END AS d, CASE WHEN strpos(reverse(x), chr(10)) = 0 THEN -1 ELSE length(x) - strpos(reverse(x), chr(10)) END AS n FROM (SELECT doc_id, text, greatest(e - 200, s + 1) AS s2, substr(text, greatest(e - 200, s + 1) + 1, 1200) AS x FROM w WHERE e < length(text))))
SELECT doc_id, s AS w_start, e AS w_end FROM w""",
    "ingest_scorecard": """WITH c AS (SELECT source, length(text) AS n, doc_id % 3 AS extra, CASE WHEN doc_id % 4 <> 0 THEN lang END AS section FROM documents)
SELECT count(*) AS chunks, count(DISTINCT source) AS papers, round_even(avg(n), 1) AS mean_chars, round_even(100.0 * count(*) FILTER (n < 200) / count(*), 1)::DOUBLE AS pct_fragmented, round_even(100.0 * count(section) / count(*), 1)::DOUBLE AS pct_sectioned, (SELECT count(*) FROM (SELECT DISTINCT source, section FROM c WHERE section IS NOT NULL)) AS sections, round_even(100.0 * count(*) FILTER (extra > 0) / count(*), 1)::DOUBLE AS pct_cross_page,
list_sort(list(n))[count(*) // 2 + 1] AS median_chars, list_sort(list(n))[floor(count(*) * 0.1)::BIGINT + 1] AS p10_chars FROM c""",
    "running_prefix": "SELECT source AS paper, 3::BIGINT AS k, 'Annual Report Two' AS prefix FROM documents GROUP BY source HAVING count(*) >= 3 AND count(*) FILTER (doc_id % 4 <> 0) >= greatest(2, floor(0.6 * count(*))) UNION ALL SELECT source, 3, 'Annual Report One' FROM documents GROUP BY source HAVING count(*) >= 3 AND count(*) FILTER (doc_id % 4 = 0) >= greatest(2, floor(0.6 * count(*)))",
    "indexed_text": "SELECT doc_id, length(text) + CASE WHEN doc_id % 2 = 0 THEN length(source) + 2 ELSE 0 END AS n FROM documents",
    "injected_scorer": "SELECT doc_id, round((length(text) % 1000) / 1000.0::DOUBLE, 6) AS score FROM documents",
    "bbox_outside": f"SELECT block_id FROM {_box('block_id', 0)} b WHERE NOT EXISTS (SELECT 1 FROM {_box('region_id', 1)} r WHERE r.page = b.page AND greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) >= 0.8 * (b.x1 - b.x0) * (b.y1 - b.y0))",
    "bbox_union": f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {_box('box_id', 0)} GROUP BY page",
    "bbox_largest": f"SELECT page, box_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, box_id) AS n FROM {_box('box_id', 0)}) WHERE n = 1",
    "bbox_flip": f"SELECT box_id, CASE WHEN h - y1 >= 0 THEN x0 END AS x0, CASE WHEN h - y1 >= 0 THEN h - y1 END AS y0, CASE WHEN h - y1 >= 0 THEN x1 END AS x1, CASE WHEN h - y1 >= 0 THEN h - y0 END AS y1 FROM (SELECT *, CASE WHEN page % 3 <> 0 THEN 500.0::DOUBLE ELSE 792.0::DOUBLE END AS h FROM {_box('box_id', 0)})",
    "caption_nearest": f"SELECT image_id, caption_id FROM (SELECT image_id, caption_id, row_number() OVER (PARTITION BY image_id ORDER BY abs((i.y0 + i.y1) / 2 - (c.y0 + c.y1) / 2), caption_id) AS n FROM {_box('image_id', 0)} i JOIN {_box('caption_id', 13)} c ON c.page = i.page) WHERE n = 1",
    "caption_recover": f"SELECT image_id, text_id FROM (SELECT image_id, text_id, row_number() OVER (PARTITION BY image_id ORDER BY side, gap, text_id) AS n FROM (SELECT image_id, text_id, CASE WHEN t.y0 - i.y1 BETWEEN 0 AND 72 THEN 0 WHEN i.y0 - t.y1 BETWEEN 0 AND 72 THEN 1 END AS side, CASE WHEN t.y0 - i.y1 BETWEEN 0 AND 72 THEN t.y0 - i.y1 ELSE i.y0 - t.y1 END AS gap FROM {_box('image_id', 0)} i JOIN {_box('text_id', 13)} t ON t.page = i.page AND least(i.x1, t.x1) > greatest(i.x0, t.x0)) WHERE side IS NOT NULL) WHERE n = 1",
    "figure_roles": f"SELECT box_id, CASE WHEN box_id % 7 = 0 THEN 'figure' WHEN box_id % 10 >= 3 AND box_id % 5 IN (0, 2) THEN 'decoration' WHEN box_id % 10 >= 3 AND box_id % 5 = 1 THEN 'figure' WHEN (x1 - x0) * (y1 - y0) < 5000 THEN 'decoration' ELSE 'figure' END AS role FROM {_box('box_id', 0)}",
    "table_markdown": "SELECT n_regionkey::BIGINT AS n_regionkey, '| name |  |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS md FROM nation GROUP BY 1",
    "graph_nodes": f"WITH {_G} {_NODES}",
    "graph_edges": f"WITH {_G} SELECT e.a, e.b, sum(weight) AS weight, any_value(ds.d) AS descriptions, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), '|') AS chunk_ids FROM ed e JOIN (SELECT a, b, string_agg(d, '|' ORDER BY f) AS d FROM (SELECT a, b, d, min(doc_id) AS f FROM ed GROUP BY ALL) GROUP BY ALL) ds ON ds.a = e.a AND ds.b = e.b GROUP BY e.a, e.b",
    "graph_metrics": f"WITH {_G}, e AS (SELECT DISTINCT a, b FROM ed), n AS (SELECT DISTINCT node FROM mn) SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, round(count(*) FILTER (node NOT IN (SELECT a FROM e UNION SELECT b FROM e)) / count(*), 6) AS isolated, round(count(*) / 100, 6) AS entities_per_chunk FROM n",
    "graph_parse": "SELECT doc_id AS chunk_id, doc_id % 7 <> 0 AND doc_id % 5 = 0 AS is_reference_list, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS n_entities, CASE WHEN doc_id % 7 <> 0 THEN greatest(0, least(10, doc_id % 30 - 5))::DOUBLE END AS weight FROM documents",
    "gallery": "SELECT source AS paper, doc_id % 9 AS page, doc_id AS chunk_id FROM documents WHERE doc_id % 3 < 2 AND NOT (doc_id % 4 = 0 AND doc_id % 1000 < 500) ORDER BY 1, 2, 3 LIMIT 100",
    "catalogue": "SELECT d.source AS paper, coalesce(n_name, d.source) AS title, count(DISTINCT doc_id % 7) AS pages, count(*) AS chunks FROM documents d LEFT JOIN nation ON 'src' || n_nationkey = d.source AND n_nationkey <> 3 GROUP BY 1, 2",
    "client_search": "SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'the ing')",
    "upsert_latest": "SELECT id, version, value FROM (SELECT event_id % 500 AS id, event_id AS version, value, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "append_new": "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 GROUP BY 1",
    "silent_misses": "SELECT DISTINCT o_custkey AS paper, 'figure' AS kind, o_orderkey % 10 AS n FROM orders WHERE o_orderkey % 10 % 3 = 0",
    "common_queries": "SELECT user_id AS query_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    "excluded_ids": "SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id // 20) - 1 AS rank FROM documents WHERE doc_id % 5 <> 0",
    "loop_detector": "SELECT run, count(*) FILTER (same) AS repeats FROM (SELECT user_id AS run, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events) GROUP BY 1",
    "quota_daily": "SELECT ts::DATE::VARCHAR AS day, least(count(*), 250) AS allowed, count(*) AS used FROM events GROUP BY 1",
    "min_max_scale": "SELECT event_id AS id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)",
    "chunk_dump": "SELECT doc_id AS chunk_id, substr(replace(text, chr(10), ' '), 1, 280) AS preview FROM documents",
    "snapshot_diff": "WITH o AS (SELECT count(*)::DOUBLE AS n, max(o_custkey)::DOUBLE AS m FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT count(*)::DOUBLE AS n, max(o_custkey)::DOUBLE AS m FROM orders) SELECT 'n' AS metric, o.n AS old, p.n AS new FROM o, p WHERE o.n <> p.n UNION ALL SELECT 'most', o.m, p.m FROM o, p WHERE o.m <> p.m",
    "prompt_version": "SELECT doc_id::VARCHAR AS name, 'v1-' || substr(sha256(text), 1, 12) AS version FROM documents",
    "judge_parse": "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN greatest(0.0, least(1.0, (doc_id - 50) / 100))::DOUBLE END AS score FROM documents",
    "stream_quota": "SELECT ts::DATE::VARCHAR AS day, count(*) AS used, least(count(*), 250) AS allowed FROM events GROUP BY 1",
    "stream_rate_limit": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS used, greatest(0, count(*) - 1) AS refused FROM events GROUP BY 1, 2",
    "stream_sessions": "SELECT user_id, start, n FROM (SELECT user_id, s, count(*) AS n, replace(min(ts)::VARCHAR, 'T', ' ') AS start FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL)",
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "chunk_pages", "graph_communities", "graph_context", "stratified_sample"]}
