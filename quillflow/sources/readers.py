"""Readers and writers: explicit schemas, malformed rows set aside rather than inferred around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = (
    "run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, golden_set_name STRING, golden_set_version STRING, config MAP<STRING, STRING>, per_query ARRAY<STRUCT<query_id: STRING, category: STRING, text: STRING, "
    "retrieved_chunk_ids: ARRAY<STRING>, retrieval: STRUCT<ndcg_at_5: DOUBLE, recall_at_10: DOUBLE, mrr: DOUBLE>, answer_text: STRING, cited_chunk_ids: ARRAY<STRING>, latency_ms: BIGINT, tokens_in: BIGINT, tokens_out: BIGINT>>"
)
CHUNK = "chunk_id STRING, paper_id STRING, page_numbers ARRAY<INT>, text STRING, section STRING, context STRING, role STRING"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the driver's folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, ..., query columns): a row for each query of the evaluation runs in JSON files."""
    r = spark.read.schema(RUN).json(path, multiLine=True)
    return r.select("run_id", "golden_set_name", "config", F.inline("per_query"))


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): lines of JSON, and the lines that do not fit the schema."""
    rows = spark.read.text(path).select("value", F.from_json("value", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    good = rows.where("j._bad IS NULL").select("j.*").drop("_bad")
    return good, rows.where("j._bad IS NOT NULL").select("value")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; rows of an older layout, which lack an id or a text, are left out."""
    return spark.read.schema(CHUNK).parquet(path).where("chunk_id IS NOT NULL AND paper_id IS NOT NULL AND text IS NOT NULL")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document for each .txt file, named by the file."""
    r = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select("*", "_metadata.file_name")
    return r.select(F.regexp_replace("file_name", r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"))


def rendered_pages(spark: SparkSession, path: str) -> DataFrame:
    """(paper, page, path): rendered pages <paper>/<paper>_p<N>.png, by exact paper."""
    p = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_p*.png").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    p = p.select("path", folder.alias("paper"), F.regexp_extract(name, r"^(.*)_p(\d+)\.png$", 1).alias("of"), F.regexp_extract(name, r"_p(\d+)\.png$", 1).cast("int").alias("page"))
    return p.where("paper = of").select("paper", "page", "path").orderBy("paper", "page")


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """(paper, title, published): entries of an Atom feed."""
    e = spark.read.format("xml").option("rowTag", "entry").schema("id STRING, title STRING, published STRING, summary STRING").load(path)
    return e.select(F.regexp_extract("id", r"/abs/([^v]+)(?:v\d+)?$", 1).alias("paper"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "published")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without comments and blanks."""
    v = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(v.alias("value")).where("value <> ''")


def title_map(spark: SparkSession, path: str) -> DataFrame:
    """(paper, title) of a JSON object; what does not parse is empty."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, STRING>").alias("m"))
    return t.where("m IS NOT NULL").select(F.explode("m").alias("paper", "title"))


def merge_table(new: DataFrame, path: str, key: str, version: str) -> None:
    """Idempotent upsert of rows by key into a parquet table: the merged table is written beside the old one and then takes its place."""
    from ..operators.browse import upsert

    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    merged = upsert(spark.read.parquet(path), new, key, version) if fs.exists(fs_path) else new
    merged.write.mode("overwrite").parquet(path + ".new")
    fs.delete(fs_path, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path + ".new"), fs_path)


def write_report(scores: DataFrame, path: str) -> None:
    """A Markdown table of per-query scores, nulls as a dash."""
    cells = [F.coalesce(F.format_number(c, 4) if t == "double" else F.col(c).cast("string"), F.lit("—")) for c, t in scores.dtypes]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    scores.orderBy(scores.columns[0]).select(line.alias("value")).write.mode("overwrite").text(path)
