"""Train, validation and test splits that keep related records together.

Entities that are linked, directly or through others, form a component (minimum labels over the links with
pointer jumping, a checkpoint a round). Components are placed whole by grouped iterative stratification: the
rarest label still outstanding first, into the split that needs it most. The few components that hold more
than a thousandth of the records each are placed one after the other; the others are dealt into blocks of
bounded size, which are placed side by side, each towards its part of what the large ones left to fill.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.arrays import all_pairs
from evidloom.session import checkpointed

#: Shares of the splits.
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
#: A component with more than this share of all records is placed by itself: at most 1 / LARGE of them.
LARGE, BLOCK = 0.001, 500


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b: bigint) is linked with.

    Edges with a null or to the node itself link nothing; repeated edges count once; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        nxt = labels.join(near, "node").select("node", F.least("component", "m").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("onward"))
        nxt = checkpointed(nxt.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("onward", "to")).alias("component")))
        if nxt.where("component <> was").isEmpty():
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")


def source_links(records: DataFrame, record_id: str, source: str, pages: DataFrame | None, page_source: str = "source", page: str = "resolved_pageid") -> DataFrame:
    """Edges (a, b) between sources that share a record id, and between a source and the positive page it resolves to."""
    r = records.where(F.col(record_id).isNotNull() & F.col(source).isNotNull()).groupBy(record_id, source).count()
    first = r.groupBy(record_id).agg(F.min(source).alias("a"), F.max(source).alias("z")).where("a <> z").select(F.col(record_id).alias("_r"), "a")
    edges = r.join(first, r[record_id] == first["_r"]).where(F.col(source) != F.col("a")).select("a", F.col(source).alias("b")).distinct()
    if pages is not None:
        p = pages.where((F.col(page) > 0) & F.col(page_source).isNotNull()).select(F.col(page_source).alias("a"), F.col(page).alias("b")).distinct()
        edges = edges.unionByName(p)
    return edges


def grouped_entities(records: DataFrame, record_id: str, source: str, pages: DataFrame | None) -> DataFrame:
    """(source, component) of every source of the records that isn't null; one without links is its own component."""
    c = components(source_links(records, record_id, source, pages))
    s = records.where(F.col(source).isNotNull()).select(F.col(source).alias("source")).distinct()
    return s.join(c, s["source"] == c["node"], "left").select("source", F.coalesce("component", "source").alias("component"))


def linked_sources(records: DataFrame, record_id: str, source: str, pages: DataFrame | None) -> DataFrame:
    """(source_a, source_b), a < b: different sources of the records that must share a split.

    Components of every size come as all their pairs; n sources have n (n - 1) / 2. Null sources and record ids
    link nothing, and neither do page ids that are null, zero or negative.
    """
    return all_pairs(grouped_entities(records, record_id, source, pages), "component", "source").select(F.col("id_a").alias("source_a"), F.col("id_b").alias("source_b"))


def _place(items: list[tuple[int, list[tuple[str, int]]]], need: dict[str, dict[str, float]], used: dict[str, dict[str, float]]) -> list[str]:
    """A split for each component (id, its labels with their records), in a fixed order.

    The label with the fewest records outstanding comes first; its components go, the largest first, to the split
    that needs that label most. ``need`` (by split and label) says what is needed; ``used`` is reduced by what is placed.
    """
    left, out = set(range(len(items))), [""] * len(items)
    size = [sum(n for _, n in own) for _, own in items]
    outstanding: dict[str, float] = {}
    having: dict[str, list[int]] = {}
    for i, (_, own) in enumerate(items):
        for lab, n in own:
            outstanding[lab] = outstanding.get(lab, 0.0) + n
            having.setdefault(lab, []).append(i)
    need = {s: dict(x) for s, x in need.items()}
    total = {s: sum(x.values()) for s, x in need.items()}
    rest = set(outstanding)
    while rest:
        lab = min(rest, key=lambda x: (outstanding[x], x))
        rest.discard(lab)
        for i in sorted((i for i in having[lab] if i in left), key=lambda i: (-size[i], i)):
            to = max(need, key=lambda s: (need[s].get(lab, 0.0), total[s], s == "train"))
            if total[to] < size[i] and max(total.values()) >= size[i]:  # never over a split that is full
                to = max(need, key=lambda s: total[s])
            out[i] = to
            left.discard(i)
            total[to] -= size[i]
            for x, n in items[i][1]:
                need[to][x] = need[to].get(x, 0.0) - n
                used[to][x] = used[to].get(x, 0.0) - n
                outstanding[x] -= n
    return out


def stratified_splits(records: DataFrame, record_id: str, source: str, label: str, pages: DataFrame | None, shares: dict[str, float] | None = None) -> DataFrame:
    """(source, component, split): every source of the records (a null source too, by itself) in one split.

    Shares hold for the records, and for each label's records, as nearly as the components allow. Labels are
    compared without case and surrounding blanks; null and blank are one label. The same input gives the same
    splits. Repeated rows count as records. An empty table gives no rows.
    """
    shares = shares or SHARES
    ent = grouped_entities(records, record_id, source, pages)
    lab = F.coalesce(F.nullif(F.lower(F.trim(F.col(label))), F.lit("")), F.lit("(none)"))
    rows = records.select(F.col(source).alias("source"), lab.alias("label")).groupBy("source", "label").agg(F.count("*").alias("n"))
    rows = rows.join(ent, "source", "left").withColumn("component", F.coalesce("component", F.lit(-1)))
    per = checkpointed(rows.groupBy("component", "label").agg(F.sum("n").alias("n")))
    totals = per.groupBy("label").agg(F.sum("n").alias("total"))
    # the labels of a component travel with it as a list, so there may be any number of them
    wide = checkpointed(per.join(totals, "label").groupBy("component").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("total", "label", "n"))).alias("labels")))
    everything, count = wide.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not count:
        return ent.withColumn("split", F.lit(None).cast("string"))
    big = [(r["component"], [(x["label"], x["n"]) for x in r["labels"]]) for r in wide.where(F.col("size") > LARGE * everything).orderBy("component").collect()]  # at most 1 / LARGE rows
    need = {s: {} for s in shares}
    held = {lab for _, own in big for lab, _ in own}
    for r in totals.collect():  # one row a label
        for s, share in shares.items():
            need[s][r["label"]] = share * r["total"]
    placed = _place(big, {s: {lab: need[s][lab] for lab in held} for s in shares}, need)
    spark = records.sparkSession
    big_split = spark.createDataFrame(list(zip([c for c, _ in big], placed, strict=True)), "component bigint, split string")
    over = {s: {lab: max(0.0, v) for lab, v in x.items()} for s, x in need.items()}
    left = {lab: sum(over[s][lab] for s in over) or 1.0 for lab in over["train" if "train" in over else next(iter(over))]}
    part = {s: {lab: v / left[lab] for lab, v in x.items()} for s, x in over.items()}
    blocks = max(1, -(-count // BLOCK))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(c, [(x["label"], x["n"]) for x in labels]) for c, labels in sorted(zip(pdf["component"].tolist(), pdf["labels"], strict=True), key=lambda r: r[0])]
        total: dict[str, float] = {}
        for _, labels in own:
            for lab, n in labels:
                total[lab] = total.get(lab, 0.0) + n
        want = {s: {lab: part[s].get(lab, shares[s]) * n for lab, n in total.items()} for s in shares}
        return pd.DataFrame({"component": [c for c, _ in own], "split": _place(own, want, want)})

    small = wide.where(F.col("size") <= LARGE * everything).withColumn("_b", F.pmod(F.xxhash64("component"), F.lit(blocks))).groupBy("_b").applyInPandas(lambda pdf: block(pdf.drop(columns="_b")), "component bigint, split string")
    out = big_split.unionByName(small)
    sources = ent.unionByName(records.where(F.col(source).isNull()).select(F.lit(None).cast("bigint").alias("source"), F.lit(-1).cast("bigint").alias("component")).limit(1))
    return sources.join(out, "component").select("source", "component", "split")


def split_classes(records: DataFrame, record_id: str, source: str, pages: DataFrame | None) -> DataFrame:
    """(source, component, members): each source with the smallest node it is linked with, and how many sources of the records share that."""
    ent = grouped_entities(records, record_id, source, pages)
    return ent.join(ent.groupBy("component").agg(F.count("*").alias("members")), "component").select("source", "component", "members")
