"""Writers: every one leaves its target whole or as it was, by the output committer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of one file of a search collection.
SHARD = 500_000


def json_array_file(df: DataFrame, path: str, order: str | None = None, pretty: bool = True) -> int:
    """The records as JSON texts, one a line within brackets, in order; returns their number. One file: for small tables."""
    body = F.to_json(F.struct(*(c for c in df.columns if c != order)), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})
    rows = df.select(F.col(order).alias("o") if order else F.lit(0).alias("o"), body.alias("value"))
    rows = rows.orderBy("o").select("value").coalesce(1)
    n = df.count()
    rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)
    return n


def collection(df: DataFrame, path: str, doc: str, text: str, shard: int = SHARD) -> None:
    """{id, contents} JSON lines in files of at most ``shard`` documents."""
    df.select(F.col(doc).cast("string").alias("id"), F.col(text).alias("contents")).write.mode("overwrite").option("maxRecordsPerFile", shard).json(path)


def split_files(df: DataFrame, path: str) -> DataFrame:
    """JSON lines in a folder per split; returns the manifest (split, records, sources)."""
    df.where("split is not null").write.mode("overwrite").partitionBy("split").json(path)
    return df.where("split is not null").groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"))


def index(post: DataFrame, path: str, partitions: int | None = None) -> None:
    """A postings table sorted by term, so that a query reads the row groups of its terms only."""
    p = post.repartitionByRange(partitions, "term") if partitions else post.repartitionByRange("term")
    p.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str, line: Column) -> None:
    """One text line a row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
