"""Readers of the pipeline's file forms: JSON arrays and keyed objects, JSON lines, dumps, caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.sources import schemas


def json_array(spark: SparkSession, path: str, schema: str = schemas.CLAIMS) -> DataFrame:
    """Records of a file that holds one JSON array. Such a file is one task; write it as parquet once."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_array_texts(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record): each record of a JSON array as text, with its place, for what needs key presence."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<variant>")).alias("ord", "v")).select("ord", F.to_json("v").alias("record"))


def json_keyed(spark: SparkSession, path: str, record: str, key: str = "source") -> DataFrame:
    """Records of a JSON object from key to record, the key as a bigint column; a missing file is an empty table.

    ``record`` is the type of a record: a struct's fields become columns, another type the column ``text``.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], "value string")
    kv = raw.select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("k", "v")).withColumn("k", F.col("k").try_cast("bigint")).where("k is not null")
    if record.lower().startswith("struct"):
        cols = [c for c in kv.select("v.*").columns if c != key]
        return kv.select(F.col("k").alias(key), *(F.col(f"v.{c}") for c in cols))
    return kv.select(F.col("k").alias(key), F.col("v").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. ``strict`` raises on a malformed line, otherwise it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def dump_articles(spark: SparkSession, path: str, pattern: str = "wiki_*") -> DataFrame:
    """(source, title, url, text, file) of extracted dump files, however deep; lines without a numeric id are dropped."""
    raw = spark.read.schema(schemas.DUMP).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return raw.select(F.col("id").try_cast("bigint").alias("source"), "title", "url", "text", F.col("_metadata.file_path").alias("file")).where("source is not null")


def corpus(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """The chunk corpus from JSON lines, one row a chunk with its place; with ``sources`` only the articles of those."""
    c = spark.read.schema(schemas.CORPUS).option("mode", "FAILFAST").json(path)
    if sources is not None:
        c = c.join(sources.select("source").distinct(), "source", "left_semi")
    return c.select("source", F.posexplode("chunks").alias("ord", "c")).select("source", "ord", "c.*")


def known_sources(ver: DataFrame) -> DataFrame:
    return ver.where("found").select("source").distinct()


def processed(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """The keys that an earlier run has written; none if it wrote nothing.

    Nothing written means no such path, or a folder without a data file. An output without the key is an error.
    """
    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"`{key}` {kind}")
    return done.select(key).distinct()
