"""Ordered operators against small worked cases and row-at-a-time models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import folds, relops, stats

SCAN = [
    # pages, seen, most pages -> new, reached, scanned
    ([["a", "b"], ["c", "d"]], "ab", 5, "", True, 2),
    ([["a", "b"], ["c", "d"], ["s", "t"]], "st", 5, "abcd", True, 6),
    ([["p", "a", "b"], ["p", "c", "d"], ["p", "o", "q"]], "poq", 5, "abcd", True, 7),
    ([["a", "b"]] * 3, "", 10, "ab", True, 2),
    ([[f"{p}{i}" for i in "xy"] for p in range(10)], "", 3, None, False, 6),
    ([["a"], [], ["b"]], "", 5, "a", True, 1),
]


@pytest.mark.parametrize("case", SCAN)
def test_boundary_scan(spark, case):
    pages, seen, most, new, reached, scanned = case
    rows = [("s", i, p) for p, ids in enumerate(pages, 1) for i in ids]
    known = spark.createDataFrame([("s", i) for i in seen] or [("other", "z")], "src string, id string")
    got = relops.boundary_scan(spark.createDataFrame(rows, "src string, id string, page int"), known, "src", "id", "page", most).collect()
    fresh = {r["id"] for r in got if r["is_new"]}
    assert fresh == ({f"{p}{i}" for p in range(3) for i in "xy"} if new is None else set(new))
    assert {r["reached"] for r in got} == {reached}
    assert {r["scanned"] for r in got} == {scanned} and len(got) == scanned


def test_scan_agrees_with_a_loop(spark):
    rng = random.Random(7)
    rows, seen, want = [], [], {}
    for s in range(60):
        pages = [[rng.choice("abcdefghij") + str(rng.randrange(3)) for _ in range(rng.randrange(0, 5))] for _ in range(rng.randrange(1, 6))]
        known = {rng.choice("abcdefghij") + str(rng.randrange(3)) for _ in range(12)}
        met, new, reached = [], [], False
        for page in range(1, 5):
            batch = pages[page - 1] if page <= len(pages) else []
            if not batch or all(i in met for i in batch):
                reached = True
                break
            for i in batch:
                if i not in met:
                    met.append(i)
                    if i not in known:
                        new.append(i)
            if all(i in known for i in batch):
                reached = True
                break
        want[s] = (sorted(new), reached, len(met))
        rows += [(s, i, p) for p, ids in enumerate(pages, 1) for i in ids]
        seen += [(s, i) for i in known]
    got: dict = {}
    for r in relops.boundary_scan(spark.createDataFrame(rows, "src int, id string, page int"), spark.createDataFrame(seen, "src int, id string"), "src", "id", "page", 4).collect():
        g = got.setdefault(r["src"], ([], r["reached"], r["scanned"]))
        if r["is_new"]:
            g[0].append(r["id"])
    for s, (new, reached, n) in want.items():
        if n:
            assert (sorted(got[s][0]), got[s][1], got[s][2]) == (new, reached, n)


def test_dedupe_union_and_turns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, pos int, v string")
    assert {r["v"] for r in relops.first_wins(df, ["k"], ["pos"]).collect()} == {"x", "z"}
    assert {r["v"] for r in relops.last_wins(df, ["k"], ["pos"]).collect()} == {"y", "z"}
    assert [r["v"] for r in relops.drop_all_duplicates(df, ["k"]).collect()] == ["z"]
    new = spark.createDataFrame([("s", "n1", 1), ("s", "o1", 2)], "s string, k string, pos int")
    old = spark.createDataFrame([("s", "o1", 1), ("s", "o2", 2), ("s", "o3", 3)], "s string, k string, pos int")
    got = relops.union_cap(new, old, "s", "k", "pos", 3).orderBy("ord").collect()
    assert [r["k"] for r in got] == ["n1", "o1", "o2"]
    rows = [("a", i) for i in range(3)] + [("b", 0)] + [("c", i) for i in range(3)]
    turn = relops.round_robin(spark.createDataFrame(rows, "g string, i int"), "g", "g", ["i"], 6)
    assert [f"{r['g']}{r['i']}" for r in turn.collect()] == ["a0", "b0", "c0", "a1", "c1", "a2"]


def test_folds(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 20, 3, 1, 1, 9])], "s string, i int, n long")
    assert [r["included"] for r in folds.first_fit(df.where("i < 3"), "s", "i", "n", 10).orderBy("i").collect()] == [True, False, True]
    assert [r["batch"] for r in folds.greedy_batches(df, "s", "i", "n", 2, 10).orderBy("i").collect()] == [0, 1, 2, 2, 3, 3]
    for n, want in ((25, 1), (37, 2), (50, 2)):
        many = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.lit(1).alias("n"))
        assert folds.greedy_batches(many, "s", "i", "n", 25, 10**6).select("batch").distinct().count() == want
    out = spark.createDataFrame([("s", i, ok) for i, ok in enumerate([True, False, False, True, False])], "s string, i int, ok boolean")
    assert [r["attempted"] for r in folds.circuit_breaker(out, "s", "i", ~F.col("ok"), 2).orderBy("i").collect()] == [True, True, True, False, False]
    assert all(r["attempted"] for r in folds.circuit_breaker(out, "s", "i", ~F.col("ok"), 0).collect())
    cut = folds.budget_cut(df, "s", "i", "n", 28.0, 2.0).orderBy("i").collect()
    assert [r["started"] for r in cut] == [True, True, True, False, False, False]


def test_stats(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "failed"), ("b", "pending"), (None, "failed")], "s string, o string")
    got = {r["s"]: (r["attempted"], r["succeeded"], r["pending"], r["failed"]) for r in stats.detail_stats(df, "s", "o").collect()}
    assert got == {"*": (4, 1, 1, 2), "a": (2, 1, 0, 1), "b": (1, 0, 1, 0), None: (1, 0, 0, 1)}
    top = spark.createDataFrame([("x", 3, 1), ("y", 3, 0), ("z", 1, 2)], "n string, c int, o int")
    assert stats.top_first(top, "n", "c", "o").first()["top"] == "y"
