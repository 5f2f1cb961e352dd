"""Golden cases of logs, states, views, branches, changes; random logs against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact.operators import branch, changes, graph, reducers, shred, views
from chronofact.operators import temporal as T

LOG = "t long, seq int, op string, e string, a string, v string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def log_of(spark, statements):
    return spark.createDataFrame([(t, k, op, e, a, v) for k, (t, op, e, a, v) in enumerate(statements)], LOG)


def test_set_expansion(spark):
    log = log_of(spark, [(0, "set", "1", "friend", "2"), (0, "set", "2", "friend", "1"), (1, "set", "1", "friend", "3")])
    datoms = T.expanded_sets(log)
    assert rows(datoms, "e", "a", "v", "t", "op") == [("1", "friend", "2", 0, "add"), ("1", "friend", "2", 1, "remove"), ("1", "friend", "3", 1, "add"), ("2", "friend", "1", 0, "add")]
    assert T.value(datoms, "1", "friend", 0).first()[0] == "2" and T.value(datoms, "1", "friend", 1).first()[0] == "3"


def test_states(spark):
    made = [("entity-1", "attribute-1", "value-1", 0, "add"), ("entity-1", "attribute-1", "value-1", 1, "remove"), ("entity-1", "attribute-1", "value-3", 1, "add"), ("entity-1", "attribute-2", "value-2", 0, "add"), ("entity-1", "attribute-3", "value-4", 0, "add")]
    datoms = spark.createDataFrame(made, "e string, a string, v string, t long, op string")
    assert rows(T.values(datoms, "entity-1", "attribute-1")) == [("value-3",)]
    assert rows(T.values(datoms, "entity-1", "attribute-1", 0)) == [("value-1",)]
    assert rows(T.entities(datoms, "attribute-2", lambda v: v.startswith("value"))) == [("entity-1",)]
    assert T.entity_maps(T.propositions(datoms)).first()["attributes"]["attribute-3"] == ["value-4"]
    assert T.permuted(datoms, "avetc").columns == ["a", "v", "e", "t", "op"]


def model_states(statements):
    state, out = {}, {}
    for t in sorted({s[0] for s in statements}):
        mine = [s for s in statements if s[0] == t]
        sets = {(e, a): set() for _, op, e, a, _ in mine if op == "set"}
        for _, op, e, a, v in mine:
            if op == "set":
                sets[e, a].add(v)
        for key, vs in sets.items():
            state[key] = set(vs)
        for _, op, e, a, v in mine:
            if op == "add":
                state.setdefault((e, a), set()).add(v)
        for _, op, e, a, v in mine:
            if op == "remove":
                state.get((e, a), set()).discard(v)
        out[t] = {(e, a, v) for (e, a), vs in state.items() for v in vs}
    return out


def random_log(rng, n):
    return [(rng.randrange(n // 3), rng.choice(["add", "add", "remove", "set"]), rng.choice("xyz"), rng.choice("ab"), rng.choice("123")) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_states(spark, seed):
    statements = random_log(random.Random(seed), 60)
    datoms = T.expanded_sets(log_of(spark, statements)).cache()
    for t, expected in list(model_states(statements).items())[::6]:
        assert set(rows(T.propositions(datoms, t))) == expected


def squash_model(statements):
    """One statement after another over a list of survivors."""
    left = []
    for op, e, a, v in statements:
        if op == "set":
            left = [s for s in left if (s[1], s[2]) != (e, a)]
            left.append((op, e, a, v))
        elif op == "add":
            left = [s for s in left if s != ("remove", e, a, v)]
            if (op, e, a, v) not in left:
                left.append((op, e, a, v))
        else:
            same = [s for s in left if s[1:] == (e, a, v)]
            left = [s for s in left if s[1:] != (e, a, v)]
            if not same:
                left.append((op, e, a, v))
    return left


@pytest.mark.parametrize(
    "before,after",
    [
        ([("add", "1"), ("remove", "1")], []),
        ([("remove", "1"), ("add", "1")], [("add", "1")]),
        ([("set", "1"), ("remove", "1")], []),
        ([("remove", "1"), ("add", "1"), ("add", "2"), ("set", "2")], [("set", "2")]),
        ([("remove", "1"), ("remove", "1")], []),
    ],
)
def test_squash(spark, before, after):
    log = log_of(spark, [(0, op, "e", "a", v) for op, v in before])
    assert rows(T.squashed(log), "op", "v") == sorted(after)


def test_squash_of_many(spark):
    statements, expected = [], []
    rng = random.Random(5)
    for k in range(150):
        own = [(rng.choice(["add", "remove", "set"]), f"e{k}", "a", rng.choice("12")) for _ in range(rng.randint(1, 6))]
        statements += [(0, *s) for s in own]
        expected += squash_model(own)
    assert rows(T.squashed(log_of(spark, statements)), "op", "e", "a", "v") == sorted(expected)


def test_full_text(spark):
    state = spark.createDataFrame([("1", "text", "beañs, ,  / pötatos-Tomatos"), ("2", "text", "2"), ("3", "text", "-")], "e string, a string, v string")
    assert rows(views.full_text(state), "token", "e") == [("2", "2"), ("beañs", "1"), ("pötatos", "1"), ("tomatos", "1")]


def test_full_text_delta_covers_all_documents(spark, tmp_path):
    from chronofact.plans.queries import QUERIES

    texts = {0: "a b", 1: "b c", 2: "c - d", 3: "e", 4: "", 5: "a", 7: "x", 8: "x y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: set(t.replace("-", " ").split()) for i, t in texts.items()}
    expected = []
    for i in texts:
        if i - 1 in texts:
            expected += [("text", w, i, "add") for w in words[i - 1] - words[i]] + [("text", w, i, "remove") for w in words[i] - words[i - 1]]
    assert sorted(tuple(r) for r in QUERIES["full_text_delta_whole"](spark, str(tmp_path)).select("a", "token", "e", "op").collect()) == sorted(expected)


@pytest.mark.parametrize("seed", range(2))
def test_folded_deltas_are_the_state(spark, seed):
    statements = random_log(random.Random(50 + seed), 18)
    datoms = T.expanded_sets(log_of(spark, statements)).cache()
    view = lambda s: views.composite(s, [("x", ["a"], None), ("y", ["b"], None)])
    built = views.caught_up(view, None, datoms)
    assert rows(T.folded(built, ["x", "y", "e"])) == rows(view(T.propositions(datoms)))


def test_composite_delta(spark):
    log = log_of(spark, [(0, "add", "entity-1", "attribute-1", "value-1"), (0, "add", "entity-1", "attribute-2", "value-2"), (1, "remove", "entity-1", "attribute-2", "value-2")])
    view = lambda s: views.composite(s, [("x", ["attribute-1"], None), ("y", ["attribute-2"], None)])
    datoms = T.expanded_sets(log)
    assert rows(views.delta(view, datoms, 0)) == [("value-1", "value-2", "entity-1", "add")]
    assert rows(views.delta(view, datoms, 1)) == [("value-1", "value-2", "entity-1", "remove")]
    letters = views.composite(T.propositions(datoms, 1), [("c", ["attribute-1"], lambda v: F.split(v, "-"))])
    assert rows(letters) == [("1", "entity-1"), ("value", "entity-1")]


def test_enumeration(spark):
    log = log_of(spark, [(0, "add", "1", "a", "value-1"), (0, "add", "2", "a", "value-1"), (1, "remove", "1", "a", "value-1"), (2, "remove", "2", "a", "value-1")])
    assert rows(views.enumeration_counts(log, "a")) == [("value-1", 0, 2), ("value-1", 1, 1), ("value-1", 2, 0)]
    assert rows(views.enumeration_live(log, "a", 1)) == [("value-1",)] and rows(views.enumeration_live(log, "a")) == []


def test_rule(spark):
    head, body = ["?category", "?amount", "?food"], [["?m", "amount", "?amount"], ["?m", "food", "?food"], ["?food", "category", "?category"]]
    log = log_of(spark, [(0, "add", "m1", "amount", "10"), (0, "add", "m1", "food", "f1"), (1, "add", "f1", "category", "pastry"), (2, "set", "m1", "amount", "5"), (3, "set", "f1", "category", "cake")])
    datoms = T.expanded_sets(log).cache()
    expected = {0: [], 1: [("pastry", "10", "f1", "add")], 2: [("pastry", "10", "f1", "remove"), ("pastry", "5", "f1", "add")], 3: [("cake", "5", "f1", "add"), ("pastry", "5", "f1", "remove")]}
    for t, changed in expected.items():
        assert rows(views.delta(views.rule(head, body), datoms, t, by_entity=False)) == changed
        assert rows(views.rule_delta(head, body, datoms, t)) == changed


def test_branches(spark):
    schema = "e long, a string, v string, t long, op string"
    up = spark.createDataFrame([(1, "name", "foo", 0, "add"), (2, "name", "baz", 1, "add")], schema)
    down = spark.createDataFrame([(1, "name", "foo", 0, "remove"), (1, "name", "bar", 0, "add")], schema)
    assert rows(branch.merged(up, down, 0)) == [(1, "name", "bar", 1, "add"), (1, "name", "foo", 0, "add"), (1, "name", "foo", 1, "remove")]
    assert (2, "name", "baz", 1, "add") in rows(branch.merged(up, down, 1)) and (1, "name", "bar", 2, "add") in rows(branch.merged(up, down, 1))
    assert rows(branch.branch_state(up, down, 1)) == [(1, "name", "bar"), (2, "name", "baz")]
    assert branch.branch_last(1, down).first()[0] == 2
    ids = "e struct<stream_id:string,id:long>, v string, t long, op string"
    merged = branch.merged_streams(spark.createDataFrame([((None, 1), "x", 0, "add")], ids), "up", spark.createDataFrame([((None, 1), "y", 0, "add"), (("up", 1), "z", 0, "add")], ids), "down", 0, ["e"])
    assert sorted((r.e.stream_id, r.e.id, r.v, r.t) for r in merged.collect()) == [("down", 1, "y", 1), ("up", 1, "x", 0), ("up", 1, "z", 1)]


def test_squashed_commit(spark):
    log = log_of(spark, [(0, "add", "1", "a", "x")])
    overlay = log_of(spark, [(0, "add", "1", "a", "y"), (1, "remove", "1", "a", "y"), (2, "add", "1", "a", "z")])
    assert rows(branch.squashed_commit(log, overlay), "t", "op", "v") == [(0, "add", "x"), (1, "add", "z")]


def test_changes(spark):
    state = spark.createDataFrame([("1", "likes", "2"), ("2", "name", "b"), ("3", "likes", "2"), ("3", "part", "4"), ("4", "part", "3"), ("4", "name", "d")], "e string, a string, v string")
    assert rows(changes.change_attribute(state, "1", "likes", "loves")) == [("add", "1", "loves", "2"), ("remove", "1", "likes", "2")]
    assert rows(changes.change_reverse_attribute(state, "2", "likes", "loves"), "op", "e") == [("add", "1"), ("add", "3"), ("remove", "1"), ("remove", "3")]
    assert rows(changes.remove_entity(state, "2"), "e", "a") == [("1", "likes"), ("2", "name"), ("3", "likes")]
    roots = spark.createDataFrame([("3",)], "e string")
    assert rows(changes.subcomponents(state, ["part"], roots)) == [("3", "4")]  # a cycle ends
    assert rows(changes.remove_component_tree(state, ["part"], roots), "e", "a") == [("3", "likes"), ("3", "part"), ("4", "name"), ("4", "part")]
    arrays = spark.createDataFrame([("9", "refs", ["1", "2"]), ("8", "refs", ["5"])], "e string, a string, v array<string>")
    assert [(r.op, r.e, r.v) for r in changes.remove_sequence_references(arrays, "2").orderBy("op").collect()] == [("add", "9", ["1"]), ("remove", "9", ["1", "2"])]


def test_traversals(spark):
    edges = spark.createDataFrame([("root", "bc", 0), ("root", "3", 1), ("bc", "1", 0), ("bc", "2", 1)], "parent string, child string, position int")
    roots = spark.createDataFrame([("root",)], "node string")
    assert [r.node for r in graph.pre_order(edges, roots).orderBy("path").collect()] == ["root", "bc", "1", "2", "3"]
    assert [r.node for r in graph.post_order(edges, roots).orderBy("path").collect()] == ["1", "2", "bc", "3", "root"]
    assert [r.node for r in graph.leaves(edges, roots).orderBy("path").collect()] == ["1", "2", "3"]
    nodes = edges.select(F.col("child").alias("node")).unionByName(roots)
    assert {r.node: r.level for r in graph.topological_levels(edges, nodes).collect()} == {"1": 0, "2": 0, "3": 0, "bc": 1, "root": 2}


def test_commits(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["a"]), ("e", ["d"])], "hash string, parents array<string>")
    assert rows(graph.novel_commits(commits, spark, "a", "c", "e")) == [("ours", "b"), ("ours", "c"), ("theirs", "d"), ("theirs", "e")]
    a = spark.range(1).select(graph.commit_hash(F.array(F.lit("x")), F.array(F.lit("s2"), F.lit("s1"))).alias("h")).first()[0]
    b = spark.range(1).select(graph.commit_hash(F.array(F.lit("x")), F.array(F.lit("s1"), F.lit("s2"))).alias("h")).first()[0]
    assert a == b and len(a) == 64


def test_shredding(spark):
    schema = "id string, name string, address struct<city:string>, friends array<struct<id:string,name:string>>, tags array<string>, `<-likes` array<struct<id:string>>"
    df = spark.createDataFrame([("1", "ann", ("x",), [("2", "bob"), (None, "cy")], ["p", "q"], [("7",)])], schema)
    assert rows(shred.shredded(df, "id"), "e", "a", "v") == sorted(
        [("1", "name", "ann"), ("1", "address", "1/address/0"), ("1/address/0", "city", "x"), ("1", "friends", "2"), ("2", "name", "bob"), ("1", "friends", "1/friends/1"), ("1/friends/1", "name", "cy"), ("1", "tags", "p"), ("1", "tags", "q"), ("7", "likes", "1")]
    )


def test_temporary_ids(spark):
    c = spark.createDataFrame([(0, "add", "tmp/a", "friend", "tmp/b"), (1, "add", "tmp/b", "name", "x"), (2, "add", "5", "friend", "tmp/c")], "seq int, op string, e string, a string, v string")
    ids = shred.temporary_ids(c, 100)
    assert rows(ids) == [("tmp/a", "100"), ("tmp/b", "101"), ("tmp/c", "102")]
    assert rows(shred.resolved(c, ids), "e", "v") == [("100", "101"), ("101", "x"), ("5", "102")]
    assert [r.label for r in shred.first_seen_labels(c, "e", "seq").orderBy("seq").collect()] == [0, 1, 2]


def test_reducers(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([1, 1, 2, 1])] + [("m", 0, 2), ("m", 1, 3)], "key string, i int, size long")
    out = reducers.partition_by_size(df, "key", "i", "size", 2)
    assert rows(out, "key", "i", "batch") == [("k", 0, 0), ("k", 1, 0), ("k", 2, 1), ("k", 3, 2), ("m", 0, 0), ("m", 1, 1)]
    n = spark.range(50)
    assert rows(reducers.with_index(n, ["id"])) == [(i, i) for i in range(50)]
    assert [r[0] for r in reducers.take_up_to(n, F.col("id") >= 3, "id").orderBy("id").collect()] == [0, 1, 2, 3]
    assert [r[0] for r in reducers.take_while_and_more(n, F.col("id") < 3, "id", 2).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert reducers.find_first(n, F.col("id") > 7, "id").first()[0] == 8
    assert reducers.first_value(n, "id", "id").first()[0] == 0 and reducers.count_rows(n).first()[0] == 50


def test_index_of_many_wide_rows(spark):
    """Counts and places are those of the rows as they were written, however partitions are planned."""
    wide = spark.range(3_000_000).select((F.col("id") * 7919 % 3_000_017).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        out = reducers.with_index(wide, ["id"]).select("id", "index").cache()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert out.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index")).first() == (3_000_000, 3_000_000, 0, 2_999_999)
    ids = wide.select("id").orderBy("id").limit(200_000).agg(F.max("id")).first()[0]
    assert out.filter("index < 200000").agg(F.max("id"), F.count("*")).first() == (ids, 200_000)
    assert out.selectExpr("id", "index").filter("index % 100000 = 0").orderBy("index").agg(F.count("*")).first()[0] == 30
    out.unpersist()


def test_one_attribute_with_very_many_events(spark):
    import time

    n = 200_000
    log = spark.range(n).select(F.col("id").alias("t"), F.when(F.col("id") % 50 == 0, "set").when(F.col("id") % 3 == 0, "remove").otherwise("add").alias("op"), F.lit(1).alias("e"), F.lit("a").alias("a"), (F.col("id") % 10).alias("v"))
    begun = time.time()
    datoms = T.expanded_sets(log)
    assert datoms.filter("op = 'add'").count() == n - len([i for i in range(n) if i % 50 and i % 3 == 0])
    assert time.time() - begun < 60


def test_last_set_value(spark):
    log = log_of(spark, [(0, "set", "x", "name", "foo"), (1, "set", "x", "name", "bar"), (0, "set", "y", "name", "a"), (1, "add", "y", "name", "b"), (0, "set", "z", "name", "c"), (2, "remove", "z", "name", "c")])
    assert {(r.e, r.v) for r in T.last_set_value(log).collect()} == {("x", "bar"), ("y", None), ("z", None)}
    assert {(r.e, r.v) for r in T.last_set_value(log, 0).collect()} == {("x", "foo"), ("y", "a"), ("z", "c")}


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("b", "d", 1), ("d", "d", 0)], "parent string, child string, position int")
    roots = spark.createDataFrame([("a",)], "node string")
    assert [r.node for r in graph.pre_order(edges, roots).orderBy("path").collect()] == ["a", "b", "c", "d"]
    assert rows(graph.closure(edges, roots), "node", "depth") == [("b", 1), ("c", 2), ("d", 2)]


def test_long_chains_are_closed(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "parent long, child long")
    assert rows(graph.closure(edges, spark.createDataFrame([(0,)], "node long")), "node", "depth") == [(k, k) for k in range(1, 41)]


def test_commits_over_references(spark):
    schema = "hash string, parents array<string>, statements array<struct<op:string,e:string,a:string,v:string>>"
    commits, refs = spark.createDataFrame([], schema), spark.createDataFrame([], "name string, hash string")
    friends = lambda name: {r.v for r in T.propositions(T.expanded_sets(graph.commit_log(commits, refs.filter(F.col("name") == name).first()["hash"]))).collect()}
    for op, v, name in (("add", "1", "master"), ("add", "2", "master")):
        commits, refs = graph.committed(commits, refs, [name], [(op, "p", "friend", v)])
    commits, refs = graph.committed(commits, refs, ["other", "master"], [("add", "p", "friend", "3")])
    commits, refs = graph.committed(commits, refs, ["master"], [("remove", "p", "friend", "1")])
    assert friends("master") == {"2"} and friends("other") == {"1", "2", "3"}
    commits, refs = graph.committed(commits, refs, ["master", "other"], [("add", "p", "friend", "4")])
    assert friends("master") == {"2", "3", "4"}
    tip = refs.filter("name = 'master'").first()["hash"]
    assert graph.first_parents(commits, tip).agg(F.max("place")).first()[0] == 3
    assert [r.children for r in graph.forks(commits).collect()] == [2]
    with pytest.raises(ValueError):
        graph.committed(commits, refs, ["master", "unknown"], [])


def test_size_report(spark):
    values = [5, 1, 9, 9, 2, 7, None, 3]
    df = spark.createDataFrame([(v,) for v in values], "size long")
    q = df.selectExpr("percentile(size, array(0.25, 0.5, 0.75))").first()[0]
    assert reducers.size_report(df, "size").first() == (7, 36, 1, *q, 9, q[2] - q[0])
    assert reducers.size_report(df.limit(0), "size").first()[0] == 0


@pytest.mark.parametrize("seed", range(2))
def test_changes_of_many_transactions_are_those_of_each(spark, seed):
    statements = random_log(random.Random(70 + seed), 30)
    datoms = T.expanded_sets(log_of(spark, statements)).cache()
    view = lambda s: views.composite(s, [("x", ["a"], None), ("y", ["b"], None)])
    numbers = sorted({s[0] for s in statements})
    each = []
    for t in [n for n in numbers if n > 2]:
        each += [(*r, t) for r in rows(views.delta(view, datoms, t))]
    assert rows(views.changes_after(view, datoms, 2)) == sorted(each)
    net = views.changes_after(view, datoms, 2, by_entity=False)
    before, after = ({tuple(r) for r in view(T.propositions(datoms, t)).collect()} for t in (2, None))
    assert {(*r[:3], r.op) for r in net.collect()} == {(*r, "add") for r in after - before} | {(*r, "remove") for r in before - after}


def test_full_text_delta_is_the_delta_of_the_view(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(rng.sample(words, 3))
    statements = [(t, rng.choice(["add", "add", "remove", "set"]), f"e{rng.randint(0, 3)}", "a", text()) for t in (0, 1, 2) for _ in range(30)]
    statements += [(0, "add", "many", "a", text()) for _ in range(20)] + [(2, "add", "many", "a", "w1 new"), (2, "add", "null", "a", None)]
    datoms = T.expanded_sets(log_of(spark, statements)).cache()
    for t in (0, 1, 2):
        found = views.full_text_delta(datoms, t)
        assert rows(found, "a", "token", "e", "op") == rows(views.delta(views.full_text, datoms, t), "a", "token", "e", "op")


def test_full_text_delta_deals_out_texts_and_no_tokens(spark, tmp_path):
    from chronofact.plans.queries import QUERIES

    spark.createDataFrame([(0, "a b"), (1, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["full_text_delta_whole"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10


def test_tokens_of_an_only_value_are_not_dealt_out(spark):
    state = spark.createDataFrame([("1", "text", "a b a"), ("2", "text", "c"), ("2", "text", "c d"), (None, "text", "x"), (None, "text", "x y"), ("3", "text", None)], "e string, a string, v string")
    out = views.full_text(state)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") < plan.index("Generate") < plan.index("Exchange")
    assert sorted((r["token"], str(r["e"])) for r in out.collect()) == [("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("x", "None"), ("y", "None")]


def test_triples_are_dealt_out_before_they_are_compared(spark):
    from chronofact.operators import shred

    rows_ = [("1", "s", [("1/a", 5), ("1/b", 6)]), ("1", "s", [("1/a", 5)]), ("2", None, None)]
    out = shred.shredded(spark.createDataFrame(rows_, "id string, status string, lines array<struct<id:string,part:int>>"), "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate")
    assert "HashAggregate" not in plan[plan.index("Exchange hashpartitioning(e") : made]
    assert rows(out, "e", "a", "v") == [("1", "lines", "1/a"), ("1", "lines", "1/b"), ("1", "status", "s"), ("1/a", "part", "5"), ("1/b", "part", "6")]
