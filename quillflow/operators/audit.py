"""Audits of answers, labels and corpora: facts in text, evidence buckets, label checks, parsers of model answers, policies and arms side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Words that carry no content of a fact, and the evidence that counts as seen or read.
STOP_WORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "at", "as", "it", "its", "this", "that",
    "these", "those", "from", "what", "which", "who", "whom", "how", "many", "much", "does", "do", "did", "page", "according", "shown", "show", "figure",
    "table", "chart", "based", "given", "following", "value", "values", "number",
)
VISUAL, TEXTUAL = ("Chart", "Figure", "Table"), ("Pure-text (Plain-text)", "Generalized-text (Layout)")


def normal_fact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9%]+", " "))


def fact_in_text(fact: Column, text: Column, share: float = 0.8) -> Column:
    """Whether a fact's normal form is in the text's, or that share of its content words is."""
    f, t = normal_fact(fact), normal_fact(text)
    content = F.filter(F.split(f, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    hits = F.size(F.filter(content, lambda w: F.contains(t, w)))
    return F.when(f == "", False).when(F.contains(t, f), True).otherwise((F.size(content) > 0) & (hits >= share * F.size(content)))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+", " "))


def normal_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "%+$", "")), "[,$]", ""), r"\s*(miles|mile|million|m|k)\b", ""))


def token_present(token: Column, text: Column) -> Column:
    """Whether a gold value is in a text: every number of a numeric one, a string between word boundaries."""
    numbers = F.regexp_extract_all(token, F.lit(r"(-?\d+\.?\d*)"), F.lit(1))
    there = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), normal_number)
    numeric = F.regexp_replace(token, r"[\d\s.\-%,]", "") == ""
    all_there = (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.array_contains(there, normal_number(n)))
    padded = F.concat(F.lit(" "), squash(text), F.lit(" "))
    clean = squash(token)
    return F.when(F.trim(token) == "", False).when(numeric, all_there).otherwise((clean != "") & F.contains(padded, F.concat(F.lit(" "), clean, F.lit(" "))))


def gold_tokens(gold: Column) -> Column:
    """The values of a gold answer: the items of a list in brackets, or the answer itself."""
    g = F.trim(gold)
    items = F.filter(F.transform(F.from_json(F.regexp_replace(g, "'", '"'), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.regexp_extract_all(g, F.lit("['\"]([^'\"]{2,})['\"]"), F.lit(1))
    as_list = F.coalesce(items, F.when(F.size(quoted) > 0, quoted), F.array(g))
    return F.when(F.startswith(g, F.lit("[")), as_list).otherwise(F.array(g))


def extraction_recall(rows: DataFrame) -> DataFrame:
    """rows (query_id, category, gold, text) to (category, full, partial, none): how many golds have all, some, or none of their values in the text, by category and ALL."""
    found = F.transform(gold_tokens(F.col("gold")), lambda t: token_present(t, F.col("text")))
    state = F.when(F.forall(found, lambda x: x), "full").when(F.exists(found, lambda x: x), "partial").otherwise("none")
    out = rows.withColumn("state", state).rollup("category").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("full", "partial", "none")])
    return out.withColumn("category", F.coalesce("category", F.lit("ALL")))


def evidence_category(sources: Column, answer_format: Column) -> Column:
    """The category that follows from evidence like "['Chart', 'Table']": no evidence or format None is out of the corpus."""
    found = F.transform(F.coalesce(F.from_json(F.regexp_replace(sources, "'", '"'), "array<string>"), F.array().cast("array<string>")), F.lower)
    has = lambda w: F.exists(found, lambda s: F.contains(s, F.lit(w)))
    return F.when((F.coalesce(answer_format, F.lit("")) == "None") | (F.size(found) == 0), "out_of_corpus").when(has("figure") | has("chart"), "figure").when(has("table"), "table").otherwise("factual")


def evidence_bucket(evidence: Column) -> Column:
    """ooc, mixed, table, figure or text, from an array of evidence names."""
    seen, read = F.array_intersect(evidence, F.array(*map(F.lit, VISUAL))), F.array_intersect(evidence, F.array(*map(F.lit, TEXTUAL)))
    visual = F.when(seen == F.array(F.lit("Table")), "table").otherwise("figure")
    return F.when(F.size(evidence) == 0, "ooc").when((F.size(seen) > 0) & (F.size(read) > 0), "mixed").when(F.size(seen) > 0, visual).otherwise("text")


def gold_page_list(pages: Column, chunk_ids: Column) -> Column:
    """The given pages, or else those that chunk ids name, in order."""
    named = F.array_distinct(F.filter(F.transform(chunk_ids, T.page_number), lambda x: x.isNotNull()))
    return F.when(F.size(pages) > 0, pages).otherwise(named)


def checked_labels(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) candidates (query_id, paper_id, category, facts, chunk_ids, pages): a known category, a paper, facts, and chunks or pages."""
    known = F.col("category").isin("factual", "multi_hop", "figure", "table", "equation", "out_of_corpus")
    ok = known & ~F.coalesce(F.col("paper_id"), F.lit("")).isin("", "TODO") & (F.size("facts") > 0) & ((F.size("chunk_ids") > 0) | (F.size("pages") > 0))
    return candidates.where(F.coalesce(ok, F.lit(False))), candidates.where(~F.coalesce(ok, F.lit(False)))


def rewrites(raw: Column, most: int) -> Column:
    """Rewritten queries of a model's answer: lines without bullets, numbers and quotes, distinct without regard to case."""
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[\"']?([-*•] )?\s*", ""), r"^\d{1,2}(\. |\) |: |- )\s*", ""), "^[\"']+|[\"']+$", ""))
    return F.slice(_first_by_key(F.filter(F.transform(F.split(raw, r"\r?\n"), clean), lambda s: s != "")), 1, most)


def subqueries(raw: Column, original: Column, most: int) -> Column:
    """Sub-queries of a model's answer, lines of three characters or more; the original where there is none."""
    clean = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[-*0-9.) ]+", ""))
    found = F.slice(_first_by_key(F.filter(F.transform(F.split(raw, r"\r?\n"), clean), lambda s: F.length(s) >= 3)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(original))


def _first_by_key(values: Column) -> Column:
    """Values whose lower case did not come before."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def split_caption(text: Column) -> Column:
    """struct(name, data): what stands before the first line with a leading pipe, and the rest."""
    at = F.regexp_instr(text, F.lit(r"(?m)^[ \t]*\|"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cut = F.struct(bare(F.substring(text, F.lit(1), at - 1)).alias("name"), bare(F.substring(text, at, F.length(text))).alias("data"))
    return F.when(at > 0, cut).otherwise(F.struct(text.alias("name"), F.lit("").alias("data")))


def reference_spans(chunks: DataFrame) -> DataFrame:
    """(paper, start, end): chunks (paper, idx from 0, text) of the reference list: its first chunk is in the back half, it ends before an appendix."""
    n = chunks.groupBy("paper").agg(F.count("*").alias("n"))
    rows = chunks.join(n, "paper")
    start = rows.where((F.col("idx") >= F.floor(F.col("n") / 2)) & F.col("text").rlike(r"(?i)^\s*(references|bibliography)\b")).groupBy("paper", "n").agg(F.min("idx").alias("start"))
    ends = chunks.where(F.col("text").rlike(r"^\s*((?i:appendix)\b|[A-Z]\s+[A-Z][a-z])")).select("paper", F.col("idx").alias("at"))
    out = start.join(ends, "paper", "left").groupBy("paper", "n", "start").agg(F.min(F.when(F.col("at") > F.col("start"), F.col("at"))).alias("end"))
    return out.select("paper", "start", F.coalesce("end", "n").alias("end"))


def recall_both_ways(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, pages_first, chunks_first): recall of gold pages (query_id, page) in the first k pages of a ranking, and in the pages of its first k chunks.  ranked: (query_id, page, rank from 0)."""
    first = ranked.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    place = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1)
    j = gold.select("query_id", "page").distinct().join(place, ["query_id", "page"], "left")
    return j.groupBy("query_id").agg((F.count_if(F.col("place") < k) / F.count("*")).alias("pages_first"), (F.count_if(F.col("rank") < k) / F.count("*")).alias("chunks_first"))


def selective_gate(base: DataFrame, other: DataFrame, sigma: float = 0.05) -> DataFrame:
    """(category, n, base, other, delta, noise, gate_on): where the other arm does not lose, by category; both (query_id, category, score)."""
    both = base.select("query_id", "category", F.col("score").alias("b")).join(other.select("query_id", F.col("score").alias("o")), "query_id")
    out = both.groupBy("category").agg(F.count("*").alias("n"), F.avg("b").alias("base"), F.avg("o").alias("other"))
    return out.withColumn("delta", F.col("other") - F.col("base")).withColumn("noise", F.lit(sigma) * F.sqrt(40 / F.col("n"))).withColumn("gate_on", F.col("other") >= F.col("base"))


def policies(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: mean scores of always base, always other, the better by category, the better by query."""
    both = base.select("query_id", "category", F.col("score").alias("b")).join(other.select("query_id", F.col("score").alias("o")), "query_id")
    by = both.groupBy("category").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("o").alias("o"), F.sum(F.greatest("b", "o")).alias("best"))
    return by.agg((F.sum("b") / F.sum("n")).alias("base"), (F.sum("o") / F.sum("n")).alias("other"), (F.sum(F.greatest("b", "o")) / F.sum("n")).alias("by_category"), (F.sum("best") / F.sum("n")).alias("by_query"))


def flips(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(category, won, lost): queries that one arm gets right and the other does not; both (query_id, category, score)."""
    both = a.select("query_id", "category", F.col("score").alias("x")).join(b.select("query_id", F.col("score").alias("y")), "query_id")
    return both.groupBy("category").agg(F.count_if((F.col("y") >= threshold) & (F.col("x") < threshold)).alias("won"), F.count_if((F.col("x") >= threshold) & (F.col("y") < threshold)).alias("lost"))


def noise_floor(runs: DataFrame) -> DataFrame:
    """(metric, n, spread): how far replicate runs (run, metric, value) are apart."""
    return runs.groupBy("metric").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"))


def adjusted(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """scored (query_id, score) after human verdicts (query_id, verdict): gold_wrong drops a row, correct counts as 1, wrong as 0, others stay."""
    j = scored.join(verdicts, "query_id", "left").where(~F.coalesce(F.col("verdict") == "gold_wrong", F.lit(False)))
    return j.select("query_id", F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "wrong", 0.0).otherwise(F.col("score")).alias("score"))


def one_of_each(rows: DataFrame, label: str, order: str) -> DataFrame:
    """All rows without a label, and the first of each label."""
    first = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias(order))
    return rows.where(F.col(label).isNull()).unionByName(rows.join(first, [label, order], "left_semi"))


def format_of(note: Column) -> Column:
    """The answer format that a golden note names, Str without one."""
    found = F.regexp_extract(F.coalesce(note, F.lit("")), r"answer_format=(\w+)", 1)
    return F.when(found != "", found).otherwise("Str")


def injected_figures(questions: DataFrame, top: DataFrame, figures: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, figure_id): figures that a question names by label, from the papers of its best results in order, one a label, most of them at most.  top: (query_id, paper, rank from 0), figures: (figure_id, paper, kind, n)."""
    says = lambda kind: F.transform(T.label_numbers(F.col("text"), kind), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("n")))
    refs = questions.select("query_id", F.posexplode(F.concat(says("table"), says("figure"))).alias("ref", "r")).select("query_id", "ref", "r.*")
    papers = top.groupBy("query_id", "paper").agg(F.min("rank").alias("rank"))
    papers = papers.withColumn("p", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("p <= 3")
    found = refs.join(papers, "query_id").join(figures, ["paper", "kind", "n"])
    first = found.groupBy("query_id", "ref").agg(F.min(F.struct("p", "figure_id")).alias("f"))
    return first.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy("ref"))).where(F.col("i") <= most).select("query_id", F.col("f.figure_id").alias("figure_id"))
