import json

import pytest
from pyspark.errors import AnalysisException

from evidloom.operators.windows import chunks
from evidloom.sources import pages, readers, schemas, writers
from evidloom.streaming.resume import chunk_stream, run_available


def test_json_forms(spark, tmp_path):
    recs = [{"final_id": 1, "source": 2, "claim": "نص", "type": None}, {"final_id": 2, "source": 2}]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    assert [r.claim for r in readers.json_array(spark, str(tmp_path / "a.json")).orderBy("final_id").collect()] == ["نص", None]
    raw = readers.json_array_texts(spark, str(tmp_path / "a.json")).orderBy("ord").collect()
    assert "type" in json.loads(raw[0].record) and "type" not in json.loads(raw[1].record)
    (tmp_path / "k.json").write_text(json.dumps({"5": "text", "x": "no", "7": ""}))
    assert {tuple(r) for r in readers.json_keyed(spark, str(tmp_path / "k.json"), "string").collect()} == {(5, "text"), (7, "")}
    (tmp_path / "v.json").write_text(json.dumps({"5": {"found": True, "title": "T"}}))
    v = readers.json_keyed(spark, str(tmp_path / "v.json"), "struct<found:boolean,title:string>").first()
    assert (v.source, v.found, v.title) == (5, True, "T")
    assert readers.json_keyed(spark, str(tmp_path / "absent.json"), "string").count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"final_id": 1, "source": 2}\n\n{bad\n{"final_id": 3, "source": 4}\n')
    ok = readers.json_lines(spark, str(tmp_path / "l.jsonl"), schemas.GOLD, strict=False)
    assert [r.final_id for r in ok.orderBy("final_id").collect()] == [1, 3]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), schemas.GOLD).collect()


def test_dump_and_corpus(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    (tmp_path / "AA" / "wiki_00").write_text('{"id": "1", "title": "t", "url": "u", "text": "A. B."}\n{"id": "x", "text": "no"}\nbad\n')
    (tmp_path / "AA" / "other").write_text('{"id": "9", "text": "no"}\n')
    d = readers.dump_articles(spark, str(tmp_path))
    assert [r.source for r in d.collect()] == [1]
    (tmp_path / "c.jsonl").write_text(json.dumps({"source": 1, "chunks": [{"chunk_id": "1:0-0", "text": "A."}, {"chunk_id": "1:1-1", "text": "B."}]}) + "\n" + json.dumps({"source": 2, "chunks": []}) + "\n")
    only = spark.createDataFrame([(1,)], "source long")
    assert [(r.ord, r.chunk_id) for r in readers.corpus(spark, str(tmp_path / "c.jsonl"), only).orderBy("ord").collect()] == [(0, "1:0-0"), (1, "1:1-1")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "train" if i else None, 5) for i in range(5)], "doc long, text string, split string, source long")
    assert writers.json_array_file(df.select("doc", "text"), str(tmp_path / "arr"), order="doc") == 5
    part = next((tmp_path / "arr").glob("part-*"))
    assert [r["text"] for r in json.loads(part.read_text())] == [f"t{i}" for i in range(5)]
    writers.collection(df.coalesce(1), str(tmp_path / "coll"), "doc", "text", shard=2)
    assert len(list((tmp_path / "coll").glob("part-*"))) == 3
    m = writers.split_files(df, str(tmp_path / "split")).collect()
    assert [(r.split, r.records, r.sources) for r in m] == [("train", 4, 1)] and (tmp_path / "split" / "split=train").exists()
    writers.index(spark.createDataFrame([("b", 1), ("a", 2)], "term string, n int"), str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 2
    writers.report(df.limit(1), str(tmp_path / "rep"), df["text"])
    writers.appended(df, str(tmp_path / "app"))
    writers.appended(df, str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 10


FIXTURE_PAGES = {1: {"title": "One", "url": "u1", "extract": "abc"}, 2: {"missing": True}}


def fixture_fetch(ids):
    if 66 in ids:
        raise OSError("down")
    return {i: FIXTURE_PAGES[i] for i in ids if i in FIXTURE_PAGES}


def test_retries_and_rows():
    waits, calls = [], []

    def fetch(ids):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {1: {"title": "x", "extract": ""}}

    assert pages.with_retries(fetch, [1], retries=5, sleep=waits.append) == {1: {"title": "x", "extract": ""}} and waits == [1.0, 2.0]
    assert pages.with_retries(fixture_fetch, [66], retries=2, sleep=waits.append) is None
    assert [r[-1] for r in pages.page_rows([1, 2, 3], fixture_fetch([1, 2, 3]))] == [None, "missing_or_invalid_pageid", "missing_or_invalid_pageid"]
    assert [r[-1] for r in pages.page_rows([1, 2], None)] == ["request_failed"] * 2


def test_page_source(spark):
    pages.register(spark)
    df = spark.read.format("pages").option("ids", "1,2,3").option("fetcher", "tests.test_sources:fixture_fetch").load()
    assert {(r.source, r.found, r.extract_chars, r.error) for r in df.collect()} == {(1, True, 3, None), (2, False, 0, "missing_or_invalid_pageid"), (3, False, 0, "missing_or_invalid_pageid")}
    ids = spark.createDataFrame([(1,), (1,), (-4,), (3,)], "source long")
    assert {(r.source, r.found) for r in pages.fetched(ids, fixture_fetch).collect()} == {(1, True), (3, False)}


def test_snapshots_and_random(spark):
    ids = spark.createDataFrame([(7,), (8,)], "source long")
    snaps = spark.createDataFrame([("b/7", "second"), ("c/7", "third")], "url string, html string")
    assert [tuple(r) for r in pages.first_snapshot(ids, snaps, ["a/", "b/", "c/"]).collect()] == [(7, "b/7", "second")]
    p = spark.createDataFrame([(i, "t" if i % 2 else "") for i in range(20)], "source long, text string")
    got = pages.random_pages(p, spark.createDataFrame([(1,)], "source long"), 4).collect()
    assert len(got) == 4 and all(r.source % 2 and r.source != 1 for r in got)


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "source long, text string"
    spark.createDataFrame([(1, "A. B."), (1, "A. B."), (2, "C.")], schema).coalesce(1).write.parquet(src)
    chunk_stream(spark, src, schema, out, state)
    assert spark.read.parquet(out).count() == 3
    spark.createDataFrame([(2, "C again."), (3, "D.")], schema).coalesce(1).write.mode("append").parquet(src)
    chunk_stream(spark, src, schema, out, state)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == ["1:0-0", "1:1-1", "2:0-0", "3:0-0"]
    run_available(spark, src, schema, "source", out, state, lambda d: chunks(d, largest=1))
    assert spark.read.parquet(out).count() == 4


def test_processed_tells_nothing_written_from_errors(spark, tmp_path):
    from evidloom.sources.readers import processed

    assert processed(spark, str(tmp_path / "none"), "k", "string").dtypes == [("k", "string")]
    spark.createDataFrame([(1,)], "other long").write.parquet(str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        processed(spark, str(tmp_path / "out"), "k").count()


def test_null_keys_come_out_once(spark, tmp_path):
    from evidloom.streaming.resume import run_available

    at = lambda x: str(tmp_path / x)
    for _ in range(2):
        spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string").write.mode("append").parquet(at("in"))
        run_available(spark, at("in"), "k long, v string", "k", at("out"), at("state"))
    assert sorted((r.k or 0) for r in spark.read.parquet(at("out")).collect()) == [0, 1]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from evidloom import session

    class Other:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            session.shared_folder(Other, "x")
        assert session.shared_folder(spark, "x").startswith("/")
