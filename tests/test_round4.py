"""Findings of round 4."""

import os
import random

from capture_spark.llm import neardup, substrings, tables

DOCS = "doc_id long, text string"


def _watched(monkeypatch, seen, module=neardup):
    real = module.stored

    def stored(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = real(df, name)
        seen.append((name, plan, out.filter("length >= 64").select("node").distinct().count() if name == "mixed" else 0))
        return out

    monkeypatch.setattr(module, "stored", stored)


def test_a_passage_that_many_texts_have_makes_no_crowd(spark, monkeypatch):
    """only texts of little else than common passages are compared by blocks."""
    pick = random.Random(3)
    line = "this very common line of some more words than others stands in all of the texts"
    texts = [" ".join([*(f"w{pick.randrange(10**6)}" for _ in range(30)), line]) for _ in range(200)]
    texts += [texts[0].replace(" w", " W"), texts[1] + " more"]
    seen = []
    _watched(monkeypatch, seen)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {k: {200: 0, 201: 1}.get(k, k) for k in range(202)}
    assert [n for name, _, n in seen if name == "mixed"] == [0]


def test_blocks_meet_over_neighbouring_sizes(spark):
    """sets of 100 and 80 to 125 shingles may be linked, so bands of sizes lose no link."""
    pick = random.Random(4)
    words = [f"w{pick.randrange(10**6)}" for _ in range(103)]
    texts = [" ".join(words[:k]) for k in (103, 83, 82, 67, 66)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS), crowd=2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate([texts[0], texts[3], texts[4]])), DOCS), crowd=2).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_nothing_is_broadcast_by_a_guess_of_its_size(spark, monkeypatch):
    """packed signatures count as small, but not the posts that come out of them."""
    texts = [f"text {k // 2} with some words that make a signature of number {k // 2}" for k in range(40)]
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    seen = []
    _watched(monkeypatch, seen)
    for op in (neardup.near_duplicates, neardup.deduplicated):
        op(spark.createDataFrame(list(enumerate(texts)), DOCS))
    assert {"posts", "live", "star", "cross"} <= {name for name, _, _ in seen}
    assert [name for name, plan, _ in seen if "BroadcastHashJoin" in plan and name != "texts"] == []
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_common_prints_are_not_broadcast_by_a_guess(spark, monkeypatch):
    """a stage of the pipeline."""
    seen = []
    _watched(monkeypatch, seen, substrings)
    docs = spark.createDataFrame([(k, " ".join(f"w{i % 50 + k // 2}" for i in range(60))) for k in range(6)], DOCS)
    assert substrings.cut(docs).count() == 6
    assert "passages" in {name for name, _, _ in seen}
    assert [name for name, plan, _ in seen if "BroadcastHashJoin" in plan] == []


def test_rows_move_when_the_tables_on_the_way_are_gone(spark, monkeypatch):
    """disk in the pipeline's second stage."""
    folder, seen, real = tables.shared_folder(spark).removeprefix("file:"), [], tables.stored
    before = set(os.listdir(folder))

    def stored(df, name):
        if name == "deduplicated":
            seen.append({x.rpartition("-")[0] for x in set(os.listdir(folder)) - before})
        return real(df, name)

    monkeypatch.setattr(tables, "stored", stored)
    texts = [f"text {k // 2} with some words that make a signature of number {k // 2}" for k in range(8)]
    assert neardup.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).count() == 4
    assert seen == [{"numbered", "stay"}]
