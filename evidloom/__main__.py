"""Command line of the pipeline's steps."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from evidloom.operators import metrics
from evidloom.plans import pipeline
from evidloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidloom")
    sub = p.add_subparsers(dest="step", required=True)

    def step(name: str, *required: str, **optional: object) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for r in required:
            s.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            flag = f"--{o.replace('_', '-')}"
            if default is False:
                s.add_argument(flag, action="store_true")
            else:
                s.add_argument(flag, default=default, type=int if isinstance(default, int) or o in ("sample_size", "max_articles") else str)
        return s

    step("gold", "claims", "verification", "articles", "output", sample_size=None, seed=42, resume=False)
    step("localization", "claims", "gold", "chunks", "output", seed=42)
    step("bm25", "queries", "chunks", split="test", query_field="claim", oracle=False, top_k=50, output=None)
    step("breakdown", "ranks")
    step("profile", "claims", "output")
    step("validate", "original", "formatted", max_diffs=5)
    step("format", "input", "output")
    step("chunks", "dump", "output", verification=None, max_window=1, max_articles=None, resume=False)
    step("collection", "chunks", "output")
    step("open", "claims", "gold", "chunks", sample_size=None, seed=42, top_k=10)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"evidloom {a.step}").getOrCreate()
    table = spark.read.parquet
    if a.step == "gold":
        pipeline.gold(spark, pipeline.read_claims(spark, a.claims), table(a.verification), table(a.articles), a.output, a.sample_size, a.seed, a.resume).groupBy("match_type").count().show()
    elif a.step == "localization":
        pipeline.localization(pipeline.read_claims(spark, a.claims), table(a.gold), table(a.chunks), a.output, a.seed).show()
    elif a.step == "bm25":
        q = table(a.queries)
        q = q.where(q["split"] == a.split) if "split" in q.columns else q
        ranks, summary = pipeline.bm25_eval(q, table(a.chunks), "evidence" if a.oracle else a.query_field, a.top_k)
        if a.output:
            ranks.join(q.select("final_id", "source", "judgement", "type", "gold_match_type").distinct(), ["final_id", "source"]).write.mode("overwrite").parquet(a.output)
        summary.show()
    elif a.step == "breakdown":
        metrics.breakdown(table(a.ranks)).orderBy("slice", "value").show(100, truncate=False)
    elif a.step == "profile":
        if a.output.rstrip("/") == a.claims.rstrip("/"):
            sys.exit("the output would overwrite the input")
        for name, df in pipeline.metadata(pipeline.read_claims(spark, a.claims)).items():
            df.write.mode("overwrite").json(f"{a.output}/{name}")
    elif a.step == "validate":
        diffs = pipeline.validated(spark, a.original, a.formatted).orderBy("ord").limit(a.max_diffs).collect()
        for d in diffs:
            print(d)
        return int(bool(diffs))
    elif a.step == "format":
        print(writers.json_array_file(readers.json_array(spark, a.input), a.output))
    elif a.step == "chunks":
        pipeline.dump_to_chunks(spark, a.dump, table(a.verification) if a.verification else None, a.output, a.max_window, a.max_articles, a.resume)
    elif a.step == "collection":
        writers.collection(table(a.chunks), a.output, "chunk_id", "text")
    elif a.step == "open":
        pipeline.open_eval(pipeline.read_claims(spark, a.claims), table(a.gold), table(a.chunks), a.top_k, a.sample_size, a.seed).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
