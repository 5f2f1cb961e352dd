"""Files, snapshots, streams, databases, scalar functions and value order."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from chronofact.functions import scalars, values
from chronofact.operators import views
from chronofact.operators.index import Index
from chronofact.operators.temporal import propositions
from chronofact.plans import costs, planning
from chronofact.sources import blobs, database, log, store, text
from chronofact.streaming import catchup

LOG = "t long, seq int, op string, e string, a string, v string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_broken_json_log_gives_its_whole_prefix(spark, tmp_path):
    lines = [json.dumps({"t": t, "seq": 0, "op": "add", "e": "1", "a": "b", "v": str(t)}) for t in range(4)]
    lines[2] = lines[2][:20]
    (tmp_path / "log.json").write_text("\n".join(lines) + "\n")
    assert [r.t for r in log.read_json(spark, str(tmp_path)).orderBy("t").collect()] == [0, 1]


def test_recovery_is_of_whole_transactions_over_all_files(spark, tmp_path):
    line = lambda t, seq: json.dumps({"t": t, "seq": seq, "op": "add", "e": "1", "a": "b", "v": str(seq)})
    (tmp_path / "0.json").write_text("\n".join([line(0, 0), line(1, 0), line(1, 1)]) + "\n")
    (tmp_path / "1.json").write_text("\n".join([line(2, 0), line(3, 0), line(3, 1)[:9]]) + "\n")
    (tmp_path / "2.json").write_text("\n".join([line(4, 0), line(5, 0)]) + "\n")
    found = lambda: sorted((r.t, r.seq) for r in log.read_json(spark, str(tmp_path)).collect())
    assert found() == [(0, 0), (1, 0), (1, 1), (2, 0)]
    (tmp_path / "1.json").write_text("\n".join([line(2, 0)[:5], line(3, 0), line(3, 1)]) + "\n")
    assert found() == [(0, 0), (1, 0), (1, 1)]
    (tmp_path / "1.json").write_text(line(2, 0)[:5] + "\n")
    assert found() == [(0, 0), (1, 0), (1, 1)]
    (tmp_path / "1.json").write_text("\n".join([line(2, 0), line(3, 0)]) + "\n")
    assert found()[-1] == (5, 0)
    (tmp_path / "2.json").write_text("\n".join([line(4, 0), line(5, 0), line(5, 1)[:4]]) + "\n")
    assert found()[-1] == (4, 0)


def test_store(spark, tmp_path):
    """A thousand transactions, views kept up in steps, and the same after reopening."""
    rng = random.Random(1)
    kinds = {"words": (["a", "token", "e"], views.full_text, True), "all": (["v"], lambda s: s.select("v").distinct(), False)}
    kept = store.Store(spark, str(tmp_path / "db"), kinds)
    statements = [[(rng.choice(["add", "add", "set", "remove"]), rng.choice("pqrst"), "name", f"w{rng.randrange(9)} x{rng.randrange(9)}")] for _ in range(1000)]
    assert kept.transact(*statements[:400]) == 399 and kept.catch_up("words") == 399 and kept.catch_up("all") == 399
    assert kept.transact(*statements[400:]) == 999
    kept = store.Store(spark, str(tmp_path / "db"), kinds)
    assert kept.last_transaction() == 999 and kept.catch_up("words") == 999 and kept.catch_up("words") == 999 and kept.catch_up("all") == 999
    for t in (None, 399, 700):
        whole = {tuple(r) for r in views.full_text(kept.state(t)).collect()}
        assert {tuple(r) for r in kept.view("words", t).select("a", "token", "e").collect()} == whole
    assert {r.v for r in kept.view("all").collect()} == {r.v for r in kept.state().collect()}
    assert {tuple(r) for r in kept.database().index("words").df.collect()} == {tuple(r) for r in kept.view("words").select("a", "token", "e").collect()}
    last = kept.append(spark.createDataFrame([("set", "p", "name", "end")], "op string, e string, a string, v string"))
    assert last == 1000 and [r.v for r in kept.state().filter("e = 'p'").collect()] == ["end"]
    with pytest.raises(KeyError):
        store.Store(spark, str(tmp_path / "none"), kinds).view("words")


def test_objects_and_counters(spark, tmp_path):
    objects = store.Objects(spark, str(tmp_path / "o"))
    assert objects.keys() == [] and objects.get("a/b") is None
    objects.put("a/b", bytes(range(256)))
    objects.put_json("x", {"k": [1, "é"]})
    assert objects.get("a/b") == bytes(range(256)) and objects.get_json("x") == {"k": [1, "é"]} and objects.keys() == ["a/b", "x"]
    assert objects.remove("x") and objects.get_json("x") is None
    counter = store.Counter(objects, "n")
    assert (counter.add(), counter.add(5)) == (1, 6) and store.Counter(objects, "n").value == 6


def test_overlay(spark):
    base = database.empty(spark).transact([("add", "1", "name", "a")])
    mine = database.overlaid(base).transact([("add", "1", "name", "b"), ("remove", "1", "name", "a")]).transact([("remove", "1", "name", "b"), ("add", "1", "name", "c")])
    named = lambda d: {r.v for r in d.state().collect()}
    assert named(mine) == {"c"} and named(base) == {"a"}
    assert {(r.op, r.v) for r in mine.statements().collect()} == {("remove", "a"), ("add", "c")}
    newer = base.transact([("add", "2", "name", "other")])
    assert named(mine) == {"c"} and named(mine.refresh(newer)) == {"c", "other"}
    done = mine.committed(newer)
    assert named(done) == {"c", "other"} and done.last_transaction() == 2


def test_scanned_rows(spark, tmp_path):
    rows = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    Index("i", ["a", "b"], rows).stored(str(tmp_path / "i"), 20)
    index = Index("i", ["a", "b"], spark.read.parquet(str(tmp_path / "i")))
    assert costs.scanned_rows(index.substitutions(["?a", "?b"])) == 10_000
    assert costs.scanned_rows(index.substitutions([5000, "?b"])) <= 1000  # by statistics, one part of the range
    assert costs.scanned_rows(index.substitutions(["?a", 3])) == 10_000  # a condition behind a free column reads all


def test_parquet_log(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(t, 0, "add", "1", "a", str(t)) for t in range(1200)], LOG)
    log.append(df.filter("t < 700"), path)
    log.append(df.filter("t >= 700"), path)
    assert log.last_transaction(spark, path) == 1199
    assert log.read(spark, path, 600, 1100).agg(F.min("t"), F.max("t"), F.count("*")).first() == (600, 1100, 501)
    assert "PartitionFilters: [isnotnull(head" in log.read(spark, path, 600)._jdf.queryExecution().executedPlan().toString()
    log.compacted(spark, path, str(tmp_path / "c"))
    log.truncated(spark, path, str(tmp_path / "t"), 1000)
    assert log.read(spark, str(tmp_path / "c")).count() == 1200 and log.read(spark, str(tmp_path / "t")).count() == 200
    assert log.branch(df, 9, df.limit(3)).agg(F.max("t")).first()[0] == 12


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(0, 0, "add", "1", "a", "x"), (150, 0, "add", "1", "a", "y")], LOG)
    assert log.latest_snapshot(spark, path) is None
    assert log.store_every(propositions, df.filter("t < 100"), path) == 0
    assert log.store_every(propositions, df.filter("t < 100"), path) is None
    assert log.store_every(propositions, df, path) == 150
    assert log.latest_snapshot(spark, path)[1].count() == 2 and log.latest_snapshot(spark, path, 100)[0] == 0
    assert log.stored_sizes(spark, path).count() > 0
    assert log.remove_old_snapshots(spark, path) == [0] and log.snapshots(spark, path) == [150]


def test_separated_values(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('"id";name;n\n1;"ann";2\n2;bob\n')
    assert text.headers(spark, str(p)) == ["id", "name", "n"]
    assert [tuple(r) for r in text.records(spark, str(p)).collect()] == [("1", "ann", "2"), ("2", "bob", None)]
    assert [tuple(r) for r in text.split_records(spark, str(p), ";").collect()] == [("1", "ann", "2"), ("2", "bob", None)]
    assert text.lines(spark, str(p)).count() == 3


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"x" * 1000)), ("b", None)], "name string, data binary")
    packed = blobs.compressed(df, "data")
    assert len(packed.first()["data"]) < 100
    assert blobs.uncompressed(packed, "data").collect() == df.collect()
    z = blobs.zipped(df.limit(1), "name", "data").first()["data"]
    (tmp_path / "a.zip").write_bytes(z)
    assert bytes(blobs.first_zip_entries(spark, str(tmp_path / "*.zip")).first()["content"]) == b"x" * 1000


def test_database(spark):
    db = database.empty(spark, {"full_text": (["a", "token", "e"], views.full_text)})
    db = db.transact([("add", "1", "name", "Foo bar")])
    pinned = db.pinned()
    db = db.transact([("set", "1", "name", "baz")])
    assert [r.token for r in db.index("full_text").df.collect()] == ["baz"]
    assert sorted(r.token for r in pinned.index("full_text").df.collect()) == ["bar", "foo"]
    db, ids = db.transact_temporary([("add", "tmp/x", "friend", "1")], 10)
    assert ids.first() == ("tmp/x", "10") and db.last_transaction() == 2
    with pytest.raises(KeyError):
        db.index("none")
    with pytest.raises(ValueError):
        db.transact_temporary([("add", "1", "a", "b")], 0, lambda d: False)


def test_streaming_catch_up(spark, tmp_path):
    source, datoms, stored = (str(tmp_path / n) for n in ("log", "datoms", "view"))
    keeper = catchup.view_keeper(lambda state: state, datoms, stored)

    def catch_up():
        q = catchup.follow(spark, source, LOG, keeper, str(tmp_path / "ck"))
        q.awaitTermination(120)

    spark.createDataFrame([(0, 0, "add", "1", "a", "x")], LOG).write.mode("append").parquet(source)
    catch_up()
    spark.createDataFrame([(1, 0, "remove", "1", "a", "x"), (1, 1, "add", "1", "a", "y")], LOG).write.mode("append").parquet(source)
    catch_up()
    assert [tuple(r) for r in catchup.kept_view(spark, stored).collect()] == [("1", "a", "y")]
    assert [tuple(r) for r in catchup.kept_view(spark, stored, 0).collect()] == [("1", "a", "x")]
    keeper(spark.createDataFrame([(1, 0, "remove", "1", "a", "x"), (1, 1, "add", "1", "a", "y")], LOG), 1)  # a replay
    assert [tuple(r) for r in catchup.kept_view(spark, stored).collect()] == [("1", "a", "y")] and spark.read.parquet(stored).count() == 3
    df, seen = catchup.observed(spark.range(5), "five")
    df.collect()
    assert seen.get["rows"] == 5


def test_planning(spark):
    needs = {"eav": [], "full_text": ["eav"], "rule": ["eav", "full_text"], "lost": ["missing"]}
    assert planning.layers(needs) == [["eav"], ["full_text"], ["rule"]]
    order = []
    planning.run_layers(needs, lambda t: order.append(t))
    assert order == ["eav", "full_text", "rule"]
    assert planning.cancelled_after(spark, 60, "g", lambda: 5) == 5

    def slow():
        time.sleep(0.3)
        raise RuntimeError("cancelled")

    assert planning.cancelled_after(spark, 0.1, "g", slow, "late") == "late"


def test_scalars(spark):
    f = lambda c: one(spark, c)
    assert f(scalars.tokenize(F.lit("beañs, ,  / pötatos-Tomatos"))) == ["beañs", "pötatos", "tomatos"]
    assert f(scalars.tokenize(F.lit("a|b"))) == ["a|b"]
    assert f(scalars.strip_quotes(F.lit('"a"'))) == "a" and f(scalars.strip_quotes(F.lit('"a'))) == '"a'
    assert tuple(f(scalars.parsed_number(F.lit("12")))) == (12, None, None)
    assert tuple(f(scalars.parsed_number(F.lit("1.5")))) == (None, 1.5, None)
    assert tuple(f(scalars.parsed_number(F.lit("x")))) == (None, None, "x")
    assert f(scalars.hexify(F.lit(10))) == "0a" and f(scalars.unhexify(F.lit("ff"))) == 255
    assert f(scalars.encoded_number(F.lit(61), 62)) == "Z" and f(scalars.encoded_number(F.lit(62), 62)) == "10" and f(scalars.encoded_number(F.lit(0), 62)) == "0"
    assert f(scalars.vlq(F.lit(300))) == "822c" and f(scalars.vlq(F.lit(5))) == "05"
    u = "123e4567-e89b-12d3-a456-426614174000"
    assert f(scalars.base64_to_uuid(scalars.uuid_to_base64(F.lit(u)))) == u
    assert f(scalars.time_interval(F.lit(3725.5))) == "1:62:5.5"
    assert f(scalars.median(F.array(*map(F.lit, [3, 1, 2])))) == 2
    assert f(scalars.split_in(F.array(*map(F.lit, [1, 2, 3, 4, 5])), 2)) == [[1, 2], [3, 4, 5]]
    assert f(scalars.insert_after(F.array(F.lit(1), F.lit(3)), F.lit(1), F.lit(2))) == [1, 2, 3]
    assert f(scalars.removed_at(F.array(F.lit(1), F.lit(2), F.lit(3)), 1)) == [1, 3]
    assert f(scalars.find_index(F.array(F.lit("a"), F.lit("b")), F.lit("b"))) == 1
    assert f(scalars.digit_count(F.lit(255), 16)) == 2 and f(scalars.bit_count(F.lit(255))) == 8
    assert f(scalars.contains_map(F.create_map(F.lit("a"), F.lit(1)), {"a": 1})) is True
    assert f(scalars.padded(F.array(F.lit(1)), 3, F.lit(0))) == [1, 0, 0] and f(scalars.padded(F.array(*map(F.lit, range(5))), 3, F.lit(0))) == [0, 1, 2]
    assert f(scalars.mapped_values(F.create_map(F.lit("a"), F.lit(1)), lambda v: v + 1)) == {"a": 2}
    date = F.make_date(F.lit(2024), F.lit(2), F.lit(29))
    assert bytes(f(scalars.date_bytes(date))) == bytes([7, 232, 2, 29]) and str(f(scalars.bytes_date(scalars.date_bytes(date)))) == "2024-02-29"
    assert f(scalars.leb128(F.lit(300))) == "ac02" and f(scalars.leb128(F.lit(0))) == "00"
    numbers = [0, 5, 127, 128, 300, 2**40]
    assert f(scalars.leb128_values(scalars.leb128_sequence(F.array(*map(F.lit, numbers))))) == numbers


def test_value_order(spark):
    v = values
    cells = [v.null_value(), v.map_value(F.create_map(F.lit("a"), F.lit("1"))), v.keyword(F.lit("a")), v.keyword(F.lit("n/a")), v.sequence(F.array(F.lit("a"))), v.sequence(F.array(F.lit("a"), F.lit("b"))), v.boolean(F.lit(False)), v.number(F.lit(-1)), v.number(F.lit(2.5)), v.string(F.lit("")), v.string(F.lit("a")), v.date(F.lit("2020-01-01")), v.uuid(F.lit("0A"))]
    schema = [spark.range(1).select(F.lit(i).alias("i"), c.cast(values.VALUE).alias("v")) for i, c in enumerate(cells) if i != 1]
    df = schema[0]
    for other in reversed(schema[1:]):
        df = df.unionByName(other)
    assert [r.i for r in df.orderBy("v").collect()] == [i for i in range(len(cells)) if i != 1]
    e = spark.range(1).select(v.local_id(F.lit(1)).alias("l"), v.global_id(F.lit("s"), F.lit(1)).alias("g"))
    assert e.select(v.is_local(F.col("l")), v.is_local(F.col("g")), F.col("l") < F.col("g"), v.made_local(F.lit("s"), F.col("g")) == v.local_id(F.lit(1))).first()[:3] == (True, False, True)
