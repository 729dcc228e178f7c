"""Corpus tools over (doc_id, text): SEARCH, FILTER, COUNT, GREP, READ, for batches of requests.

Requests are literal patterns that the driver compiles into one expression each, so the
corpus is read once for each request and only rows that match leave a task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNIPPET = 300


def _literal(term: str) -> str:
    """A pattern that matches the term as it is."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", term)


def terms_of(query: str, most: int = 24) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(r"[A-Za-z0-9]+", query.lower()) if len(t) > 1))[:most]


def _snippet(pattern: str):
    line = F.element_at(F.filter(F.split("text", r"\n"), lambda x: F.lower(x).rlike(pattern)), 1)
    return F.coalesce(F.substring(F.trim(line), 1, SNIPPET), F.lit(""))


def search(corpus: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(doc_id, score, snippet): documents by occurrences of any term as a substring; among equals the larger id first."""
    found = terms_of(query)
    pattern = "|".join(map(_literal, found))
    if not found:
        return corpus.where(F.lit(False)).select("doc_id", F.lit(0).alias("score"), F.lit("").alias("snippet"))
    hits = corpus.withColumn("score", F.regexp_count(F.lower("text"), F.lit(pattern))).where("score > 0")
    return hits.orderBy(F.desc("score"), F.desc("doc_id")).limit(k).select("doc_id", "score", _snippet(pattern).alias("snippet"))


def filter_all(corpus: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """(doc_id, score, snippet): documents that have every term, by their occurrences in sum."""
    found = [t.lower() for t in terms if len(t) > 1]
    if not found:
        return corpus.where(F.lit(False)).select("doc_id", F.lit(0).alias("score"), F.lit("").alias("snippet"))
    counts = [F.regexp_count(F.lower("text"), F.lit(_literal(t))) for t in found]
    hits = corpus.where(F.least(*counts, F.lit(1)) > 0).withColumn("score", sum(counts[1:], counts[0]))
    return hits.orderBy(F.desc("score"), F.desc("doc_id")).limit(k).select("doc_id", "score", _snippet("|".join(map(_literal, found))).alias("snippet"))


def count(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """(term, docs, occurrences) of each term; under two characters 0, 0.  One pass for all terms."""
    aggs = []
    for i, t in enumerate(terms):
        n = F.regexp_count(F.lower("text"), F.lit(_literal(t.lower()))) if len(t) > 1 else F.lit(0)
        aggs += [F.count_if(n > 0).alias(f"d{i}"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"o{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("docs"), F.col(f"o{i}").alias("occurrences")) for i, t in enumerate(terms)])
    return corpus.agg(*aggs).select(F.inline(rows))


def grep(corpus: DataFrame, pattern: str, k: int = 20, fixed: bool = False, ignore_case: bool = True) -> DataFrame:
    """(doc_id, line, text): matching lines by document and line, k at most."""
    wanted = ("(?i)" if ignore_case else "") + (_literal(pattern) if fixed else pattern)
    lines = corpus.where(F.col("text").rlike(wanted)) if fixed else corpus
    lines = lines.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("pos", "ln")).where(F.col("ln").rlike(wanted))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.substring(F.trim("ln"), 1, SNIPPET).alias("text")).orderBy("doc_id", "line").limit(k)


def read(corpus: DataFrame, start: int, end: int) -> DataFrame:
    """(doc_id, view): lines start..end of each document, numbered."""
    lines = F.slice(F.split("text", r"\n"), start, end - start + 1)
    return corpus.select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x)), "\n").alias("view"))
