"""Golden cases of patterns, scans and joins."""

import pytest
from pyspark.sql import functions as F

from chronofact.operators import patterns as P
from chronofact.operators import query as Q
from chronofact.operators.index import Index, row_set

TRIPLES = [
    ("measurement-5", "nutirent", "nutrient-1"),
    ("measurement-1", "amount", "10"),
    ("measurement-1", "food", "food-1"),
    ("food-1", "category", "pastry"),
    ("measurement-2", "nutirent", "nutrient-1"),
    ("measurement-2", "amount", "20"),
    ("measurement-2", "food", "food-2"),
    ("food-2", "category", "meat"),
]
BODY = [["?m", "amount", "?amount"], ["?m", "food", "?food"], ["?food", "category", "?category"]]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def eav(spark):
    return row_set(spark, "eav", "e string, a string, v string", TRIPLES)


@pytest.fixture(scope="module")
def rows3(spark):
    return row_set(spark, "rows3", "c1 long, c2 long, c3 long", [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, 1), (3, 2, 1)])


def test_conjunctive_query(eav):
    found = Q.query([(eav, *BODY)])
    assert rows(found, "m", "amount", "food", "category") == [("measurement-1", "10", "food-1", "pastry"), ("measurement-2", "20", "food-2", "meat")]
    seeded = Q.query([(eav, *BODY)], {"category": "meat"})
    assert rows(seeded, "m", "category") == [("measurement-2", "meat")]


def test_seed_frame(spark, eav):
    seed = spark.createDataFrame([("pastry",), ("fish",)], "category string")
    assert rows(Q.query([(eav, *BODY)], seed), "m") == [("measurement-1",)]


def test_scalar_indexes_join(spark):
    a, b = row_set(spark, "a", "value long", [(1,), (2,), (3,)]), row_set(spark, "b", "value long", [(3,), (4,), (5,), (1,)])
    assert rows(Q.query([(a, ["?a"]), (b, ["?a"])])) == [(1,), (3,)]


def test_prefix_patterns_join(spark):
    pairs = row_set(spark, "pairs", "k string, n long", [("ab", 1), ("ab", 2), ("bb", 1)])
    assert rows(Q.query([(pairs, [P.starts_with("a"), "?n"], [P.starts_with("b"), "?n"])])) == [(1,)]
    words = row_set(spark, "words", "w string", [("abc",), ("acd",), ("ace",), ("ada",)])
    assert rows(words.substitutions([P.starts_with("ac", "w")])) == [("acd",), ("ace",)]


def test_trailing_conditions(rows3):
    assert rows(rows3.matches([2, "?x", 2])) == [(2, 1, 2), (2, 3, 2)]
    assert P.has_trailing_conditions([2, "?x", 2]) and not P.has_trailing_conditions([2, "?x"])
    # a prefix-only pattern gives the whole tail
    assert rows(rows3.filter_by_pattern([2])) == [(2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, 1), (3, 2, 1)]
    assert rows(rows3.filter_by_pattern([2, None, 2])) == [(2, 1, 2), (2, 3, 2)]


def test_bag_and_unique(rows3):
    assert rows(rows3.substitutions([2])) == [(), (), ()]
    assert rows(rows3.substitutions(["?x"])) == [(1,), (1,), (2,), (2,), (2,), (3,), (3,)]
    assert rows(rows3.unique_prefix(1)) == [(1,), (2,), (3,)]
    assert rows(rows3.unique_substitutions(["?x", 1])) == [(1,), (2,), (3,)]


def test_minimum_is_a_scan_bound(rows3):
    always = P.Match(lambda c: F.lit(True), "x", 2)
    assert rows(rows3.substitutions([always])) == [(2,), (2,), (2,), (3,), (3,)]
    # after a free column it bounds nothing
    assert len(rows(rows3.substitutions(["?y", P.Match(lambda c: F.lit(True), "x", 2)]))) == 7
    assert rows(rows3.substitutions([2, P.Match(lambda c: F.lit(True), "x", 2)])) == [(2,), (3,)]


def test_repeated_variable_in_a_pattern(rows3):
    assert rows(rows3.substitutions(["?x", "?x"])) == sorted((b,) for _, b in [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)])
    assert rows(rows3.substitutions(["?x", "?x"], strict=True)) == [(1,), (2,)]


def test_scans(rows3):
    assert [tuple(r) for r in rows3.scan([2, 2]).collect()] == [(2, 2, 1), (2, 3, 2), (3, 1, 1), (3, 2, 1)]
    assert [tuple(r) for r in rows3.scan([2], reverse=True).collect()] == [(2, 3, 2), (2, 2, 1), (2, 1, 2), (1, 2, 1), (1, 1, 1)]
    assert tuple(rows3.first().first()) == (1, 1, 1) and tuple(rows3.first(reverse=True).first()) == (3, 2, 1)
    assert [rows3.neighbour(2, k).first()[0] for k in ("ge", "gt", "lt", "le")] == [2, 3, 1, 2]


def test_merge_join(spark):
    left = row_set(spark, "l", "tag string, id1 long, id2 long, b string", [("a", 1, 4, "b1"), ("b", 2, 5, "b2"), ("b", 3, 7, "b3")])
    right = row_set(spark, "r", "tag string, id1 long, id2 long, a string", [("a", 1, 4, "a1"), ("a", 2, 5, "a2-1"), ("a", 2, 5, "a2-2"), ("b", 3, 7, "a3")])
    found = Q.merge_join([(left, ["b", "?id1", "?id2", "?b"]), (right, ["a", "?id1", "?id2", "?a"])])
    assert rows(found, "id1", "id2", "b", "a") == [(2, 5, "b2", "a2-1"), (2, 5, "b2", "a2-2")]
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert Q.common_key([["b", "?id1", "?id2", "?b"], ["a", "?id1", "?id2", "?a"]]) == ["id1", "id2"]
    with pytest.raises(ValueError):
        Q.merge_join([(left, ["?wrong"]), (right, ["?tag"])])


def test_loop_join_takes_distinct_prefixes(spark, rows3):
    subs = spark.createDataFrame([(1,), (2,)], "x long")
    assert rows(Q.loop_join(rows3, ["?x"], subs)) == [(1,), (2,)]


def test_rename_and_equals(eav):
    assert P.variable_name(P.rename("?food", "f")) == "f"
    assert rows(eav.substitutions(["?e", P.equals("a", "category"), "?v"]), "e", "a") == [("food-1", "category"), ("food-2", "category")]
    P.check_pattern(["food"], [P.rename("?food", "f")])


def test_bound_predicates_stay(eav):
    pattern = P.substitute([P.Match(lambda c: c.startswith("x"), "e"), "?a"], {"e": "food-1", "a": None})
    assert rows(eav.substitutions(pattern)) == []


def test_cross_product_only_where_asked(eav):
    plan = Q.query([(eav, *BODY)])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_filters_reach_the_scan(spark, rows3, tmp_path):
    rows3.stored(str(tmp_path / "i"))
    stored = Index("i", rows3.columns, spark.read.parquet(str(tmp_path / "i")))
    plan = stored.substitutions([2, "?x"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c1,2)" in plan and "c3" not in plan.split("ReadSchema")[1]
    bound = stored.scan([2])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c1,2)" in bound


def test_values_that_look_like_variables(spark):
    df = spark.createDataFrame([("?x", 1), ("*", 2), ("y", 3), (None, 4)], "a string, n int")
    index = Index("i", ["a", "n"], df)
    for value, n in (("?x", 1), ("*", 2), (None, 4)):
        assert [r.n for r in index.substitutions([P.Constant(value), "?n"]).collect()] == [n]
    assert [r.n for r in index.substitutions(P.substitute(["?a", "?n"], {"a": "?x"})).collect()] == [1]


def nations(spark, folder, customers, suppliers):
    """Customers and suppliers of nation 7 mostly, and a nation that only one side has, and nulls."""
    spark.createDataFrame([(7, "P"), (8, "Q")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    for name, n, c in (("customer", customers, "c"), ("supplier", suppliers, "s")):
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
        nation = F.when(F.col("id") == 0, 8 if c == "c" else 9).when(F.col("id") > 1, 7).cast("int")
        spark.range(n + 2).select(F.col("id").alias(key), nation.alias(f"{c}_nationkey")).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return sum(counts), max(counts) / sum(counts)


def test_scalar_join_of_one_key_is_dealt_out(spark, tmp_path):
    from chronofact.plans.queries import QUERIES

    nations(spark, tmp_path, 1500, 1000)
    out = QUERIES["bgp_scalar_join"](spark, str(tmp_path))
    n, share = largest_share(out)
    assert n == 1_500_000 and share < 0.5
    assert [r["x"] for r in out.distinct().collect()] == [7]


def test_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "RUN", 3)
    monkeypatch.setattr(Q, "RUNS", 2)
    df = spark.createDataFrame([("a", n) for n in range(1, 20)], "k string, n long")
    assert sorted(r["n"] for r in Q.repeated(df, F.col("n")).collect()) == sorted(n for n in range(1, 20) for _ in range(n))


def test_merge_join_of_one_key_is_dealt_out(spark, tmp_path, monkeypatch):
    from chronofact.plans.queries import QUERIES

    nations(spark, tmp_path, 300, 200)
    monkeypatch.setattr(Q, "BLOCK", 40)
    out = QUERIES["merge_join_three"](spark, str(tmp_path))
    n, share = largest_share(out)
    assert n == 60_000 and share < 0.6
    assert out.distinct().count() == n and [tuple(r) for r in out.select("n", "name").distinct().collect()] == [(7, "P")]
