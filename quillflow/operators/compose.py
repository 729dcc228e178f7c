"""Composed retrieval, projections of chunks and results, and small reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import context, fusion

Retriever = Callable[[DataFrame], DataFrame]


def validated(queries: DataFrame, most: int = 100) -> DataFrame:
    """queries (text, top_k) with reason: why one can't be asked, null if it can."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return queries.withColumn("reason", F.when(blank, "empty text").when(F.col("top_k").isNull() | ~F.col("top_k").between(1, most), "top_k out of range"))


def pipeline(legs: DataFrame, chunks: DataFrame, top: int, scorer: Column | None = None, keep: int = 50) -> DataFrame:
    """(query_id, id, rank, score): pools of several retrievers (query_id, leg, id, rank) without decoration, fused by reciprocal rank, and reranked by an injected score if there is one.  chunks: (id, role, text)."""
    plain = legs.where(F.col("rank") < keep).join(chunks.select("id", "role").where("role = 'decoration'"), "id", "left_anti")
    again = W.partitionBy("query_id", "leg").orderBy("rank")
    fused = fusion.rrf(plain.withColumn("rank", F.row_number().over(again) - 1).select("query_id", "leg", "id", "rank"), top=top if scorer is None else keep)
    if scorer is None:
        return fused.select("query_id", "id", "rank", "score")
    named = fused.join(chunks.select("id", "text"), "id").withColumnRenamed("id", "chunk_id")
    return context.rerank(named, scorer, top).select("query_id", F.col("chunk_id").alias("id"), "rank", F.col("rerank_score").alias("score"))


def by_path(queries: DataFrame, branches: dict[str, Retriever]) -> DataFrame:
    """(query_id, path, ...): each query (query_id, path, ...) answered by the retriever of its path; queries of other paths get nothing."""
    out = None
    for path, retrieve in branches.items():
        part = retrieve(queries.where(F.col("path") == path)).withColumn("path", F.lit(path))
        out = part if out is None else out.unionByName(part)
    return out


def multi_query(variants: DataFrame, retrieve: Retriever, top: int) -> DataFrame:
    """(query_id, id, rank, score): variants (query_id, variant, text) of each query, searched apart by retrieve (query_id, text) to (query_id, id, rank) and fused by reciprocal rank; a variant without results counts for nothing."""
    asked = variants.select(F.concat_ws("|", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("query_id"), "text")
    part = F.split("query_id", r"\|")
    legs = retrieve(asked).select(part[0].cast("bigint").alias("query_id"), part[1].cast("int").alias("leg"), "id", "rank")
    return fusion.rrf(legs, top=top).select("query_id", "id", "rank", "score")


def figure_chunks(figures: DataFrame) -> DataFrame:
    """figures (figure_id, vlm, pdf) with text: the model's caption, else the page's, else the id in brackets."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return figures.withColumn("text", F.coalesce(given("vlm"), given("pdf"), F.concat(F.lit("["), F.col("figure_id").cast("string"), F.lit("]"))))


def table_chunks(tables: DataFrame) -> DataFrame:
    """tables (caption, markdown) with text: both, a blank line between them, or the one there is."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return tables.withColumn("text", F.concat_ws("\n\n", given("caption"), given("markdown")))


def as_results(hits: DataFrame, chunks: DataFrame, source: str = "pipeline") -> DataFrame:
    """hits (query_id, chunk_id, score, rank) with their chunk's paper and text; a section joins the metadata.  Hits of unknown chunks go."""
    known = chunks.select("chunk_id", "paper", "text", F.when(F.coalesce("section", F.lit("")) != "", F.map_concat("metadata", F.create_map(F.lit("section"), "section"))).otherwise(F.col("metadata")).alias("metadata"))
    return hits.join(known, "chunk_id").withColumn("source", F.lit(source))


def browse_items(figures: DataFrame) -> DataFrame:
    """(figure_id, kind, role, image_url) of figures (figure_id, paper, kind, role): without a label a figure is a figure; tables have no role."""
    role = F.when(F.col("kind") == "figure", F.coalesce("role", F.lit("figure")))
    return figures.select("figure_id", "kind", role.alias("role"), F.format_string("/papers/%s/figures/%s/image", "paper", F.col("figure_id").cast("string")).alias("image_url"))


def large_images(images: DataFrame, least: int = 64) -> DataFrame:
    return images.where((F.col("width") >= least) & (F.col("height") >= least))


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, id, rank from 0) with score 1 / (rank + 1)."""
    return ranked.withColumn("score", 1.0 / (F.col("rank") + 1))


def carried_sections(blocks: DataFrame) -> DataFrame:
    """blocks (paper, ord, label, text) but the headers, with the section of the latest header that has a text."""
    title = F.when((F.col("label") == "section_header") & (F.trim("text") != ""), F.trim("text"))
    latest = F.last(title, ignorenulls=True).over(W.partitionBy("paper").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("section", latest).where("label <> 'section_header'")


def rescored(gold: DataFrame, run: DataFrame) -> DataFrame:
    """gold (query_id, score) with a run's score where it has one."""
    return gold.join(run.select("query_id", F.col("score").alias("_new")), "query_id", "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def failures(facts: DataFrame) -> DataFrame:
    """(category, n, present, converted, missed): facts (category, in_context, correct) whose evidence was retrieved, retrieved and answered, and not retrieved; a row ALL sums them."""
    out = facts.rollup("category").agg(F.count("*").alias("n"), F.count_if("in_context").alias("present"), F.count_if(F.col("in_context") & F.col("correct")).alias("converted"), F.count_if(~F.col("in_context")).alias("missed"))
    return out.withColumn("category", F.coalesce("category", F.lit("ALL")))


def candidate_scores(pages: DataFrame) -> DataFrame:
    """(paper, pages, score) of papers of 8 to 45 pages: 1.5 for a page with figures, 2 for one with tables, 0.05 for any.  pages: (paper, page, has_figure, has_table)."""
    n = pages.groupBy("paper").agg(F.countDistinct("page").alias("pages"), F.count_if("has_figure").alias("f"), F.count_if("has_table").alias("t"))
    return n.where("pages BETWEEN 8 AND 45").select("paper", "pages", (1.5 * F.col("f") + 2 * F.col("t") + 0.05 * F.col("pages")).alias("score"))


def misroute_rate(routed: DataFrame) -> DataFrame:
    """(n, misrouted, rate): queries (needs_visual, path) that need the visual leg, and those of them on the text path."""
    out = routed.where("needs_visual").agg(F.count("*").alias("n"), F.count_if(F.col("path") == "text").alias("misrouted"))
    return out.withColumn("rate", F.coalesce(F.try_divide("misrouted", "n"), F.lit(0.0)))


def own_document(ranked: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, id, rank): results (query_id, paper, id as paper::page, rank) of the query's own paper, ranked anew."""
    own = ranked.where(F.startswith(F.col("id"), F.concat(F.col("paper"), F.lit("::"))))
    return own.withColumn("new", F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1).where(F.col("new") < top).select("query_id", "id", F.col("new").alias("rank"))


def holds_gold(rows: DataFrame) -> DataFrame:
    """rows (gold, answer) with held: the answer contains the trimmed gold text, in any case; a blank gold is held by nothing."""
    gold = T.simple_lower(T.trim_spaces(F.col("gold")))
    return rows.withColumn("held", F.coalesce((gold != "") & F.contains(T.simple_lower(F.col("answer")), gold), F.lit(False)))


def first_documents(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the first n papers by name."""
    return rows.join(rows.select("paper").distinct().orderBy("paper").limit(n), "paper", "left_semi")


def refusal_rows(queries: DataFrame, refused: DataFrame, text: str) -> DataFrame:
    """(query_id, answer, model): the constant answer of refused queries."""
    return queries.join(refused.where("refused").select("query_id"), "query_id", "left_semi").select("query_id", F.lit(text).alias("answer"), F.lit("refusal-gate").alias("model"))


def visual_wins(text_recall: DataFrame, visual_recall: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, recall, place): queries that the text leg misses entirely and the visual leg answers, best first."""
    won = text_recall.where("recall = 0").select("query_id").join(visual_recall.where(F.col("recall") >= least), "query_id")
    return won.withColumn("place", F.row_number().over(W.orderBy(F.desc("recall"), "query_id")))


def dense_within(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, score): the pages (paper, doc_id, vec) of a query's own paper by cosine, norms guarded by 1e-9.  queries: (query_id, paper, qvec)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))
    met = queries.join(pages, "paper").select("query_id", "doc_id", (dot("vec", "qvec") / (norm("vec") * norm("qvec"))).alias("score"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")) - 1)
