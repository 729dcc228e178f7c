"""BM25 over a corpus (doc_id, text), for batches of queries (query_id, text).

Statistics are corpus-global: filters on documents apply after scoring.  Only the
postings of terms that some query has are joined with the queries; they never meet
the corpus in a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Most rows of a broadcast side.
SMALL = 200_000


def sized_broadcast(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has so few rows; larger ones join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): how often each term is in each document, and the document's length in tokens."""
    toks = corpus.select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(corpus: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings(corpus).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_idf(corpus: DataFrame, posts: DataFrame) -> DataFrame:
    """(term, idf, avgdl): idf is ln(N - df + 0.5) - ln(df + 0.5), or EPSILON of the mean over all terms where that is negative."""
    n = corpus.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col("text")))).alias("avgdl"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row of totals
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with the query; repeated query terms count as often as they occur."""
    posts = postings(corpus)
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(term_idf(corpus, posts), "term")
    tf = F.col("tf")
    gain = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posts.join(sized_broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))


def ranked(scored: DataFrame, k: int, by: str = "query_id", order: str = "doc_id") -> DataFrame:
    """The best k of each query with their rank from 1; scores equal to 9 places tie, ties go to the smaller id."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.round("score", 9)), order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, keep=None) -> DataFrame:
    """(query_id, doc_id, score, rank); keep, a condition on corpus columns, filters after scoring."""
    scored = scores(corpus, queries)
    if keep is not None:
        scored = scored.join(corpus.where(keep).select("doc_id"), "doc_id", "left_semi")
    return ranked(scored, k)


def pad_with_unmatched(hits: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Fills queries with under k hits with documents of score 0 in order of their id: k of them suffice for any query."""
    fill = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
    have = hits.groupBy("query_id").agg(F.count("*").alias("have"))
    short = queries.select("query_id").join(have, "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < k)
    rest = short.join(F.broadcast(fill)).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rest = rest.withColumn("rank", F.col("have") + F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))).where(F.col("rank") <= k)
    return hits.select("query_id", "doc_id", "score", "rank").unionByName(rest.select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank"))


def within_group(corpus: DataFrame, queries: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank) of a BM25 whose statistics are those of one group of documents; queries carry their group."""
    toks = corpus.select("doc_id", group, T.tokens(F.col("text")).alias("toks"))
    stats = toks.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    posts = toks.select("doc_id", group, F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("doc_id", group, "dl", "term").agg(F.count("*").alias("tf"))
    raw = posts.groupBy(group, "term").agg(F.count("*").alias("df")).join(stats, group).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = raw.groupBy(group).agg(F.avg("raw").alias("mean"))
    idf = raw.join(means, group).select(group, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("query_id", group, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", group, "term").agg(F.count("*").alias("qtf"))
    tf = F.col("tf")
    gain = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = posts.join(idf, [group, "term"]).join(sized_broadcast(asked), [group, "term"]).groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))
    return ranked(scored, k)
