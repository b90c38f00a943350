"""Plans that keep a query within the driver's memory and the disk: how often rows are shuffled."""

import os
import re

import pytest

from evidloom.operators import lexical
from evidloom.plans import catalog

DATA = "/root/testdata/sf0.001"

#: Shuffles of the largest plan that a query runs; those of broadcasts' inputs count.
SHUFFLES = {"bm25_gold_ranks": 5, "bm25_metrics": 6, "bm25_oracle_ceiling": 6, "bm25_recall_gate": 6, "metric_breakdown": 6, "overlap_bins": 6, "overlap_quintiles": 8, "overlap_slices": 6}


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single|Single)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, name):
    assert shuffles(catalog.QUERIES[name](spark, DATA)) <= SHUFFLES[name]


def test_gold_ranks_of_divided_sources(spark, monkeypatch):
    texts = ["a b c", "a b c", "d", "", "a a d e", "zz", "b b", "a d"]
    ch = spark.createDataFrame([(s, i, f"{s}:{i}-{i}", t) for s in (1, 2) for i, t in enumerate(texts)] * 2, "source long, ord int, chunk_id string, text string")
    claims = ["a d", "", "nothing", "a a b", None, "b", "zz zz a"]
    rows = [(i, s, claims[i % 7], f"{s}:{i % 9}-{i % 9}" if i % 11 else None, i % 3) for i in range(60) for s in (1, 2, 3, None)]
    q = spark.createDataFrame(rows, "final_id long, source long, claim string, gold_chunk_id string, mark int")
    ranked = {(r.final_id, r.source, r.chunk_id): r.rk for r in lexical.rank_in_document(q, ch.distinct(), "final_id", "claim", k=6).collect()}
    for part in (2_000, 7):
        monkeypatch.setattr(lexical, "PART", part)
        got = sorted((tuple(r) for r in lexical.gold_ranks(q, ch, "final_id", "claim", k=6, also=("mark",)).collect()), key=str)
        assert got == sorted(((i, s, g, m, ranked.get((i, s, g))) for i, s, _, g, m in rows), key=str)
