import json
import os

import pytest

from evidloom.__main__ import main
from evidloom.operators import windows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_steps_follow_each_other(spark, tmp_path, capsys):
    t = {n: f"{DATA}/{n}.parquet" for n in ("arafa", "articles", "source_verification")}
    windows.chunks(spark.read.parquet(t["articles"])).write.parquet(str(tmp_path / "chunks"))
    args = ["gold", "--claims", t["arafa"], "--verification", t["source_verification"], "--articles", t["articles"], "--output", str(tmp_path / "gold")]
    assert main([*args, "--sample-size", "40"], spark) == 0
    n = spark.read.parquet(str(tmp_path / "gold")).select("final_id").distinct().count()
    assert 0 < n <= 40
    assert main([*args, "--resume"], spark) == 0
    labels = spark.read.parquet(str(tmp_path / "gold"))
    assert labels.count() == labels.select("final_id", "source").distinct().count() > n
    assert main(["localization", "--claims", t["arafa"], "--gold", str(tmp_path / "gold"), "--chunks", str(tmp_path / "chunks"), "--output", str(tmp_path / "loc")], spark) == 0
    loc = spark.read.json(str(tmp_path / "loc"))
    assert loc.groupBy("source").agg({"split": "count"}).count() > 0 and {r.split for r in loc.select("split").distinct().collect()} <= {"train", "val", "test"}
    loc.write.parquet(str(tmp_path / "q"))
    assert main(["bm25", "--queries", str(tmp_path / "q"), "--chunks", str(tmp_path / "chunks"), "--split", "train", "--output", str(tmp_path / "ranks")], spark) == 0
    assert main(["breakdown", "--ranks", str(tmp_path / "ranks")], spark) == 0
    assert main(["open", "--claims", t["arafa"], "--gold", str(tmp_path / "gold"), "--chunks", str(tmp_path / "chunks"), "--sample-size", "20"], spark) == 0
    assert main(["collection", "--chunks", str(tmp_path / "chunks"), "--output", str(tmp_path / "coll")], spark) == 0
    assert main(["profile", "--claims", t["arafa"], "--output", str(tmp_path / "meta")], spark) == 0
    with pytest.raises(SystemExit):
        main(["profile", "--claims", t["arafa"], "--output", t["arafa"]], spark)
    assert "recall_at_1" in capsys.readouterr().out


def test_validate_and_chunks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"final_id": 1, "claim": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"claim": "x", "final_id": 1}], indent=2))
    (tmp_path / "c.json").write_text(json.dumps([{"claim": "y", "final_id": 1}]))
    both = lambda x: main(["validate", "--original", str(tmp_path / "a.json"), "--formatted", str(tmp_path / x)], spark)
    assert both("b.json") == 0 and both("c.json") == 1
    assert main(["format", "--input", str(tmp_path / "a.json"), "--output", str(tmp_path / "f")], spark) == 0
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "wiki_01").write_text("".join(json.dumps({"id": str(i), "title": "t", "url": "u", "text": x}) + "\n" for i, x in [(1, "A. B."), (1, "again."), (2, " "), (3, "C.")]))
    args = ["chunks", "--dump", str(tmp_path / "dump"), "--output", str(tmp_path / "corpus")]
    assert main(args, spark) == 0 and main([*args, "--resume"], spark) == 0
    assert {r.source for r in spark.read.parquet(str(tmp_path / "corpus")).collect()} == {1, 3}
