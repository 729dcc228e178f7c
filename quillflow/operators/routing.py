"""Query routing: categories by pattern, dispatch to legs, cascade and budget decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the categories, in order of precedence; only the last is case-sensitive.
PATTERNS = (
    ("table", r"(?i)\btable\s+\d+|\bcell\b|\brow\b|\bcolumn\b"),
    ("figure", r"(?i)\bfigure\s+\d+|\bfig\.\s*\d+|\bplot\b|\bdiagram\b|\bchart\b|\bgraphs?\b"),
    ("multi_hop", r"(?i)\bcompare\b|\bvs\.?\b|\bversus\b|\bdifferences?\b|\bbetween\b"),
    ("factual", r"\b\d+(?:\.\d+)?\b|\b[A-Z]{2,}\b"),
)
HYBRID = ("figure", "table", "multi_hop")
CASCADE_THRESHOLD = 0.85


def category(text: Column) -> Column:
    """table, figure, multi_hop, factual or definitional: the first pattern that occurs."""
    out = F.lit("definitional")
    for name, pattern in reversed(PATTERNS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def path(cat: Column) -> Column:
    return F.when(cat.isin(*HYBRID), "hybrid").otherwise("text")


def dispatch(queries: DataFrame) -> DataFrame:
    """queries (query_id, text, force_route) with category, path and whether the path was forced."""
    cat = category(F.col("text"))
    forced = F.col("force_route").isin("text", "hybrid")
    return queries.select("query_id", cat.alias("category"), F.when(forced, F.col("force_route")).otherwise(path(cat)).alias("path"), F.coalesce(forced, F.lit(False)).alias("forced"))


def cascade(queries: DataFrame, results: DataFrame, threshold: float = CASCADE_THRESHOLD) -> DataFrame:
    """(query_id, top_score, decision): text is enough if the first result's score reaches the threshold; no result counts as 0.  results: (query_id, score, rank from 0)."""
    top = results.where(F.col("rank") == 0).select("query_id", F.col("score").alias("top_score"))
    out = queries.join(top, "query_id", "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
    decision = (
        F.when(F.col("force_route") == "text", "forced_text").when(F.col("force_route") == "hybrid", "forced_hybrid").when(F.col("top_score") >= threshold, "confident_text").otherwise("uncertain_hybrid")
    )
    return out.select("query_id", F.when(F.col("force_route") == "hybrid", 0.0).otherwise(F.col("top_score")).alias("top_score"), decision.alias("decision"))


def visual_or_text(text: DataFrame, fused: DataFrame) -> DataFrame:
    """The fused results of each query, or its text results where the visual leg brought none."""
    return fused.unionByName(text.join(fused.select("query_id").distinct(), "query_id", "left_anti"))


def route_by_fit(queries: DataFrame, pages: DataFrame, topk: DataFrame, budget: int) -> DataFrame:
    """(query_id, page_number, whole): all pages of the query's paper if they fit the budget (equality fits), else those of its top results.  queries: (query_id, paper), pages: (paper, page_number), topk: (query_id, page_number)."""
    sizes = pages.groupBy("paper").agg(F.count_distinct("page_number").alias("n"))
    fit = queries.join(sizes, "paper").withColumn("whole", F.col("n") <= budget)
    whole = fit.where("whole").join(pages.select("paper", "page_number").distinct(), "paper").select("query_id", "page_number", "whole")
    some = fit.where("NOT whole").join(topk.select("query_id", "page_number").distinct(), "query_id").select("query_id", "page_number", "whole")
    return whole.union(some)


def safe_paper_id(paper: Column) -> Column:
    return paper.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~paper.contains("..")
