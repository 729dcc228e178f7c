"""Literal expectations of single operators."""

import random

from pyspark.sql import functions as F

from quillflow.functions import text as T
from quillflow.operators import bm25, browse, context, evaluate, fusion, graph, ingest, lexical, regions, routing, vectors
from quillflow.sources import readers


def col(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_rrf_puts_what_both_lists_have_first(spark):
    lists = spark.createDataFrame([(1, 0, "c1", 0), (1, 0, "c2", 1), (1, 1, "c2", 0), (1, 1, "c3", 1)], "query_id int, leg int, id string, rank int")
    out = [r["id"] for r in fusion.rrf(lists).orderBy("rank").collect()]
    assert out[0] == "c2" and set(out) == {"c1", "c2", "c3"}


def test_page_weight_decides(spark):
    text = spark.createDataFrame([(1, "a", 1, 1.0, 0), (1, "b", 2, 0.5, 1)], "query_id int, id string, page int, score double, rank int")
    seen = spark.createDataFrame([(1, "v3", 3, 9.0, 0), (1, "v2", 2, 8.0, 1)], "query_id int, id string, page int, score double, rank int")
    order = lambda w: [r["page"] for r in fusion.weighted_page_rrf(text, seen, weight=w).orderBy("rank").collect()]
    assert order(1.0) == [2, 1, 3] and order(10.0) == [2, 3, 1]
    shown = {r["page"]: (r["source"], r["id"]) for r in fusion.weighted_page_rrf(text, seen).collect()}
    assert shown[2] == ("pipeline", "b") and shown[3] == ("visual", "v3")


def test_bm25_finds_the_match(spark):
    corpus = spark.createDataFrame([(1, "Attention is all you need in a transformer"), (2, "Convolution networks"), (3, "attention span"), (4, "plain words"), (5, "more plain words")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "attention transformer")], "query_id int, text string")
    hits = bm25.search(corpus, q, 2).orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == [1, 3]
    padded = bm25.pad_with_unmatched(bm25.search(corpus, q, 4), corpus, q, 4).orderBy("rank").collect()
    assert [h["doc_id"] for h in padded] == [1, 3, 2, 4] and padded[2]["score"] == 0


def test_categories(spark):
    cases = [("see Table 3", "table"), ("Figure 2 vs Figure 4", "figure"), ("compare A and b", "multi_hop"), ("what is BLEU", "factual"), ("accuracy of 3.5", "factual"), ("what is attention", "definitional"), ("the plot", "figure"), ("a row", "table")]
    df = spark.createDataFrame(cases, "text string, want string").withColumn("got", routing.category(F.col("text")))
    assert all(g == w for g, w in col(df, "got", "want"))


def test_cascade(spark):
    q = spark.createDataFrame([(1, None), (2, None), (3, "hybrid"), (4, None)], "query_id int, force_route string")
    r = spark.createDataFrame([(1, 0.85, 0), (2, 0.2, 0), (3, 0.9, 0)], "query_id int, score double, rank int")
    got = {x["query_id"]: (x["top_score"], x["decision"]) for x in routing.cascade(q, r).collect()}
    assert got == {1: (0.85, "confident_text"), 2: (0.2, "uncertain_hybrid"), 3: (0.0, "forced_hybrid"), 4: (0.0, "uncertain_hybrid")}


def test_lexical_tools(spark):
    corpus = spark.createDataFrame([("paris", "capital\nin 1889 built"), ("rome", "old 12 capital capital")], "doc_id string, text string")
    assert col(lexical.grep(corpus, r"\b18\d\d\b"), "doc_id", "line") == [("paris", 2)]
    assert col(lexical.search(corpus, "capital"), "doc_id", "score") == [("rome", 2), ("paris", 1)]
    assert col(lexical.filter_all(corpus, ["capital", "old"]), "doc_id", "score") == [("rome", 3)]
    assert col(lexical.count(corpus, ["capital", "x"]), "term", "docs", "occurrences") == [("capital", 2, 3), ("x", 0, 0)]
    assert lexical.read(corpus, 2, 2).where("doc_id = 'paris'").first()["view"] == "2: in 1889 built"
    assert lexical.search(corpus, "!").count() == 0


def test_graph_merge(spark):
    e = spark.createDataFrame([(0, "c0", 0, "BGE-M3", "method", "x"), (1, "c1", 0, "bge-m3", "method", "y")], "chunk_ix int, chunk_id string, ent_ix int, name string, type string, description string")
    r = spark.createDataFrame([(0, "c0", 0, "A", "B", "d", 3.0), (1, "c1", 0, "b", "a", "", 4.0), (1, "c1", 1, "A", " a ", "", 9.0)], "chunk_ix int, chunk_id string, rel_ix int, source string, target string, description string, weight double")
    nodes = {n["node"]: n for n in graph.nodes(e, r).collect()}
    assert nodes["bge-m3"]["chunk_ids"] == ["c0", "c1"] and nodes["bge-m3"]["display"] == "BGE-M3" and nodes["bge-m3"]["descriptions"] == ["x", "y"]
    assert col(graph.edges(r), "a", "b", "weight") == [("a", "b", 7.0)]


def test_communities_separate_two_cliques(spark):
    names = [f"{g}{i}" for g in "xy" for i in range(4)]
    pairs = [(a, b, 1.0) for a in names for b in names if a < b and a[0] == b[0]] + [("x0", "y0", 0.1)]
    nodes, edges = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs, "a string, b string, weight double")
    got = dict(col(graph.communities(nodes, edges), "node", "community"))
    assert got == {n: n[0] + "0" for n in names}


def test_windows_cover_and_overlap():
    rnd = random.Random(4)
    for n in (0, 5, 1200, 1201, 5000):
        text = "".join(rnd.choice("abc. \n") for _ in range(n))
        spans = ingest.window_spans(text)
        assert (not spans) == (n == 0)
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == n and all(b >= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_packing_keeps_the_first(spark):
    r = spark.createDataFrame([(1, "a", 0, "x" * 50), (1, "b", 1, "y"), (2, "c", 0, "z"), (2, "d", 1, "w" * 9), (2, "e", 2, "v")], "query_id int, chunk_id string, rank int, text string")
    assert sorted(x[0] for x in col(context.pack(r, 10), "chunk_id")) == ["a", "c"]


def test_anls_and_refusal(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), ("", ""), ("abcd", "abzz")], "g string, p string").withColumn("s", T.anls(F.col("g"), F.col("p")))
    assert [r["s"] for r in df.collect()] == [1.0, 0.0, 1.0, 0.0]
    df = spark.createDataFrame([(" Not stated in the provided context. x",), ("It is not stated in the provided context",), (None,)], "a string").withColumn("r", T.is_refusal(F.col("a")))
    assert [r["r"] for r in df.collect()] == [True, False, False]


def test_latency_uses_bankers_rounding(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6)], "value double")
    assert col(evaluate.latency(df), "n", "p50", "p95", "mean") == [(6, 3.0, 6.0, 3.5)]


def test_boxes(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 3.0, 3.0, 10.0), (2, 5.0, 1.0, 4.0, 3.0, 10.0), (3, 0.0, 5.0, 1.0, 12.0, 10.0)], "id int, x0 double, y0 double, x1 double, y1 double, page_height double")
    got = {r["id"]: r["y0"] for r in regions.flip(df).collect()}
    assert got == {1: 7.0, 2: None, 3: None}


def test_cosine_ties_go_to_the_smaller_id(spark):
    base = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "doc_id int, vec array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, qvec array<double>")
    assert [r["doc_id"] for r in vectors.cosine_topk(base, q, 3).orderBy("rank").collect()] == [1, 3, 2]


def test_safe_ids_and_upsert(spark):
    df = spark.createDataFrame([("2301.1",), ("../x",), ("a..b",), ("-x",)], "p string").withColumn("ok", routing.safe_paper_id(F.col("p")))
    assert [r["ok"] for r in df.collect()] == [True, False, False, False]
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k int, v int, x string")
    assert sorted(col(browse.upsert(old, new, "k", "v"), "k", "x")) == [(1, "a"), (2, "c"), (3, "d")]


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    assert col(readers.text_folder(spark, str(tmp_path / "t")), "doc_id", "text") == [("a", "one\ntwo")]
    (tmp_path / "m.txt").write_text("# c\n2301.1 # x\n\n")
    assert col(readers.manifest(spark, str(tmp_path / "m.txt")), "value") == [("2301.1",)]
    (tmp_path / "j.jsonl").write_text('{"id": "1"}\n{broken\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "j.jsonl"), "id STRING")
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "r.json").write_text('[{"run_id": "r", "per_query": [{"query_id": "q", "retrieval": {"mrr": 0.5}}]}]')
    assert readers.runs(spark, str(tmp_path / "r.json")).select("query_id", "retrieval.mrr").first() == ("q", 0.5)
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2301.1v2</id><title>A\n B</title><published>x</published></entry></feed>")
    assert col(readers.atom_feed(spark, str(tmp_path / "f.xml")), "paper", "title") == [("2301.1", "A B")]
    for n in (2, 1):
        p = tmp_path / f"img/p1/p1_p{n}.png"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert col(readers.rendered_pages(spark, str(tmp_path / "img")), "paper", "page") == [("p1", 1), ("p1", 2)]


def test_merge_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int")
    for _ in range(2):
        readers.merge_table(new, str(tmp_path / "t"), "k", "v")
    readers.merge_table(spark.createDataFrame([(2, 5)], "k int, v int"), str(tmp_path / "t"), "k", "v")
    assert sorted(col(spark.read.parquet(str(tmp_path / "t")), "k", "v")) == [(1, 1), (2, 5)]


def test_incremental_index(spark, tmp_path):
    from quillflow.streaming import jobs

    spark.createDataFrame([(1, "a b a")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    jobs.index_batches(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(col(spark.read.parquet(str(tmp_path / "ix")), "term", "tf")) == [("a", 2), ("b", 1)]


def test_packing_counts_what_separates_kept_blocks_only(spark):
    rows = [(1, "a", 0, "x" * 10), (1, "b", 1, "y" * 10)]
    r = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, text string")
    assert [x[0] for x in sorted(col(context.pack(r, 22), "chunk_id"))] == ["a", "b"] and len(context.pack(r, 21).collect()) == 1
    named = r.withColumn("page_numbers", F.array(F.lit(3), F.lit(4)))
    assert context.pack(named, 100).agg(F.max("used")).first()[0] == 2 * len("[a] (pages 3, 4) " + "x" * 10) + 2


def test_expansion_cap_counts_additions(spark):
    chunks = spark.createDataFrame([(i, 0, 0, i) for i in range(60)], "chunk_id int, paper int, page int, idx int")
    hits = spark.createDataFrame([(1, 3 * i + 1, 1.0, i) for i in range(10)], "query_id int, chunk_id int, score double, rank int")
    assert context.expand(hits, chunks).count() == 22
    links = spark.createDataFrame([(1, 50, 1)], "query_id int, chunk_id int, anchor_id int")
    got = [r["chunk_id"] for r in context.expand(hits, chunks, links=links).orderBy("rank").collect()]
    assert got[10:14] == [0, 2, 50, 3] and len(got) == 22


def test_decoration_without_a_document_goes(spark, tmp_path):
    """The vectors have more rows than the documents: those that are decoration leave the dense leg too."""
    from quillflow.plans import compose

    spark.createDataFrame([(i, f"word{i} same", "src", "en") for i in range(3)], "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "same")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 10)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["id"] for r in compose.pipeline_retriever(spark, str(tmp_path)).collect()}
    assert found == {1, 2, 3, 5, 6, 7, 9}


def test_gold_substring_maps_letters_one_by_one(spark, tmp_path):
    """Letters that Java's full case mapping turns into several, or by their place in a word, against the SQL."""
    import duckdb

    from quillflow.plans import compose

    texts = ["12Straße 4 und", "xyΑΣ ΟΔΟΣ", "xyİstanbul", "xyﬁnd ŉ ǰa", "xy\u00a0\u3000 wide", "xyᾳ ᾀ ᾈ ΐ", "xyſ ı ς K", "xy\t\n\n\n\n\n\n\n\n", "xy  \u2003", "", None]
    rows = [(4 * i + k, x, "src", lang) for i, x in enumerate(texts) for k, lang in ((0, "en"), (1, "en"), (2, "STRASSE"), (3, None))]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(col(compose.gold_substring(spark, str(tmp_path)), "doc_id", "held")) == sorted(con.sql(compose.ORACLES["gold_substring"]).fetchall())
    letters = [(chr(i),) for i in range(1, 0x3000)]
    got = spark.createDataFrame(letters, "c string").select(T.simple_upper(F.col("c")).alias("u"), T.simple_lower(F.col("c")).alias("l"), "c")
    con.execute("CREATE TABLE t (c VARCHAR)")
    con.execute("INSERT INTO t SELECT chr(i::INT) FROM range(1, 12288) r(i)")
    want = {c: (u, low) for c, u, low in con.sql("SELECT c, upper(c), lower(c) FROM t").fetchall()}
    newer = "ƛɤ\u1c89\u1c8a"  # pairs of Unicode 16, which Spark's tables have
    assert [x["c"] for x in got.collect() if (x["u"], x["l"]) != want[x["c"]] and x["c"] not in newer] == []


def test_stream_result_stays_out_of_the_driver(spark, tmp_path):
    """Results are files that executors write; in append mode those of all batches, in complete mode the last."""
    from quillflow.streaming import jobs

    for k in range(3):
        spark.sql(f"SELECT id AS event_id, timestamp_seconds({k} * 86400 * 9 + id) AS ts, id % 2 AS user_id, 'a' AS event_type, 1.0D AS value, '' AS props FROM range({k + 1})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    src = lambda: jobs.events(spark, f"{tmp_path}/events")
    whole = jobs.run_available(jobs.rate_limit(src(), 1, "1 day"), "whole", f"{tmp_path}/c1")
    assert whole.inputFiles() and sum(r["used"] for r in whole.collect()) == 6 and whole.count() == 5
    appended = jobs.run_available(src().select("event_id"), "appended", f"{tmp_path}/c2/", "append")
    assert appended.inputFiles() and sorted(col(appended, "event_id")) == [(0,), (0,), (0,), (1,), (1,), (2,)]


def test_session_state_is_on_disk(spark, tmp_path):
    """State of sessions is RocksDB's files, and the session's setting is as before."""
    import glob

    from quillflow.streaming import jobs

    spark.sql("SELECT id AS event_id, timestamp_seconds(id * 3600 * (1 + id % 3)) AS ts, 7L AS user_id, 'a' AS event_type, 1.0D AS value, '' AS props FROM range(9)").write.parquet(f"{tmp_path}/events")
    before = spark.conf.get(jobs.STATE[0])
    out = jobs.run_available(jobs.sessions(jobs.events(spark, f"{tmp_path}/events"), "2 hours"), "visits", f"{tmp_path}/c")
    # hours 0, 2, 3, 6, 6, 8, 14, 15, 24: a pause of more than two hours begins a visit
    assert sorted(n for (n,) in col(out, "n")) == [1, 2, 3, 3]
    assert glob.glob(f"{tmp_path}/c/state/**/*.zip", recursive=True) and spark.conf.get(jobs.STATE[0]) == before


def test_pause_of_six_hours_begins_a_session(spark, tmp_path):
    """The SQL begins a session at a pause of six hours exactly."""
    from quillflow.plans import corpus

    spark.sql("SELECT id AS event_id, timestamp_seconds(id * 21600) AS ts, 7L AS user_id, 'a' AS event_type, 1.0D AS value, '' AS props FROM range(3)").write.parquet(f"{tmp_path}/events.parquet")
    assert col(corpus.stream_sessions(spark, str(tmp_path)), "n") == [(1,)] * 3


def test_long_paper_is_chunked_in_time(spark):
    """A paper of 6 million characters: its text is cut once, not carried along with each of its windows."""
    import time

    page = "some plain words of a page and that is all. " * 30
    pages = spark.range(4500).select(F.lit("p").alias("paper"), F.col("id").alias("page_number"), F.concat(F.when(F.col("id") % 1500 == 700, "2 Methods of It\n").otherwise(""), F.concat(F.col("id").cast("string"), F.lit(" "), F.lit(page))).alias("text"))
    begin = time.monotonic()
    rows = ingest.chunk(pages).collect()
    assert time.monotonic() - begin < 60
    assert {r["section"] for r in rows} == {None, "2 Methods of It"} and len({r["chunk_id"] for r in rows}) == len(rows)
    assert sorted({n for r in rows for n in r["page_numbers"]}) == list(range(4500))
    # a window of 1200 characters of pages of over 1200 lies on one or two of them
    assert all(len(r["page_numbers"]) <= 2 and len(r["text"]) <= 1200 for r in rows)


def test_communities_of_a_small_graph_take_few_jobs(spark):
    """Rounds in one task and rounds in joins agree, and the first need no job for each round."""
    r = random.Random(5)
    pairs = {tuple(sorted((f"n{g}é{r.randrange(9)}", f"n{g if r.random() < 0.8 else r.randrange(6)}é{r.randrange(9)}"))) for g in range(6) for _ in range(25)}
    edges = spark.createDataFrame([(a, b, float(r.randrange(1, 5))) for a, b in sorted(pairs) if a != b], "a string, b string, weight double")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(spark.createDataFrame([("alone",)], "node string")).distinct()
    sc = spark.sparkContext
    sc.setJobGroup("small-graph", "")
    got = sorted(col(graph.communities(nodes, edges, 2), "node", "community"))
    jobs = len(sc.statusTracker().getJobIdsForGroup("small-graph"))
    sc.setJobGroup("other", "")
    assert jobs <= 20 and got == sorted(col(graph.communities(nodes, edges, 2, one_task=0), "node", "community"))
