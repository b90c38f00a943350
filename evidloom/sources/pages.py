"""A page service as a Spark data source: batches of ids, retries with growing waits, one row an id whatever happens.

``PageSource`` reads (source, found, title, url, extract_chars, error) for the ids in its option ``ids`` through a
fetcher named in the option ``fetcher`` as ``module:function``; offline that is a function over a table of
fixtures. A fetcher takes a list of ids and gives a dict from id to a dict of fields.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetcher = Callable[[list[int]], dict[int, dict]]
RETRIES, BACKOFF, BATCH = 5, 1.0, 20


def with_retries(fetch: Fetcher, ids: list[int], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> dict[int, dict] | None:
    """What the fetcher gives, tried again after growing waits; None if it fails every time."""
    for k in range(retries + 1):
        try:
            return fetch(ids)
        except Exception:
            if k == retries:
                return None
            sleep(backoff * 2**k)
    return None


def page_rows(ids: list[int], got: dict[int, dict] | None) -> Iterator[tuple]:
    """A row for each asked id: the page, ``request_failed`` for a whole failed batch, or ``missing_or_invalid_pageid``."""
    for i in ids:
        p = (got or {}).get(i)
        if got is None:
            yield i, False, None, None, 0, "request_failed"
        elif p is None or p.get("missing"):
            yield i, False, None, None, 0, "missing_or_invalid_pageid"
        else:
            yield i, True, p.get("title"), p.get("url"), len(p.get("extract") or ""), None


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "source bigint, found boolean, title string, url string, extract_chars int, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = [int(x) for x in options.get("ids", "").split(",") if x]
        self.fetcher = options["fetcher"]
        self.batch = int(options.get("batch", BATCH))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.ids[i : i + self.batch]) for i in range(0, len(self.ids), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        return page_rows(partition.value, with_retries(fetch, partition.value))


def fetched(ids: DataFrame, fetch: Fetcher, key: str = "source", batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """The same for a table of ids: each is asked for once, in batches, on the executors."""

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for f in frames:
            own = f[key].tolist()
            rows = [r for i in range(0, len(own), batch) for r in page_rows(own[i : i + batch], with_retries(fetch, own[i : i + batch], retries))]
            yield pd.DataFrame(rows, columns=["source", "found", "title", "url", "extract_chars", "error"])

    return ids.select(key).where(F.col(key) > 0).distinct().mapInPandas(run, PageSource.schema(None))  # type: ignore[arg-type]


def first_snapshot(ids: DataFrame, snapshots: DataFrame, variants: list[str]) -> DataFrame:
    """(source, url, html): the first of an id's URL variants that an archive has."""
    v = F.array(*(F.struct(F.lit(i).alias("n"), F.concat(F.lit(p), F.col("source").cast("string")).alias("url")) for i, p in enumerate(variants)))
    x = ids.select("source", F.explode(v).alias("v")).select("source", "v.n", "v.url").join(snapshots.select("url", "html"), "url")
    return x.groupBy("source").agg(F.min_by("url", "n").alias("url"), F.min_by("html", "n").alias("html"))


def random_pages(pages: DataFrame, known: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n usable pages (with a text, not known) in seeded order."""
    from evidloom.functions.text import seeded

    return pages.where("coalesce(text, '') <> ''").join(known, "source", "left_anti").orderBy(seeded("source", seed), "source").limit(n)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
