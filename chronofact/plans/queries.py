"""Registered queries over the driver's tables, and the same as SQL.

events is the log: t = event_id div 10, e = user_id, a = event_type, v = the
value's whole part modulo 10; every fifth event removes, every seventh of the
others sets, the rest add. Dimension tables are relation indexes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, values
from ..operators import branch, changes, graph, reducers, shred, views
from ..operators import patterns as P
from ..operators import query as Q
from ..operators import temporal as T
from ..operators.index import Index
from ..shared import own_folder
from ..sources import database, store
from ..sources import log as logs

N = 500  # a transaction number in the middle of the smallest log
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def relation(spark: SparkSession, d: str, name: str, columns: list[str]) -> Index:
    return Index(name, columns, table(spark, d, name).select(*columns))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    op = F.when(i % 5 == 0, "remove").when(i % 7 == 0, "set").otherwise("add")
    return table(spark, d, "events").select(
        F.expr("event_id div 10").alias("t"),
        i.alias("seq"),
        op.alias("op"),
        F.col("user_id").alias("e"),
        F.col("event_type").alias("a"),
        (F.floor("value").cast("long") % 10).alias("v"),
    )


def event_datoms(spark: SparkSession, d: str, t: int | None = None) -> DataFrame:
    """The datoms up to t, which depend on the log up to t only."""
    return T.expanded_sets(T.as_of(event_log(spark, d), t))


def plain_datoms(spark: SparkSession, d: str) -> DataFrame:
    """The log with sets as adds, where expansion does not matter."""
    return event_log(spark, d).withColumn("op", F.when(F.col("op") == "remove", "remove").otherwise("add"))


def customer_triples(spark: SparkSession, d: str) -> DataFrame:
    """(e, a, v) with string values."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return shred.triples_from_columns(c, "c_custkey", rename={"c_name": "name", "c_nationkey": "nation", "c_mktsegment": "segment"})


LOG = """log AS (SELECT event_id // 10 AS t, event_id AS seq,
    CASE WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 7 = 0 THEN 'set' ELSE 'add' END AS op,
    user_id AS e, event_type AS a, CAST(floor(value) AS BIGINT) % 10 AS v FROM events)"""
PLAIN = LOG + """, plain AS (SELECT t, seq, CASE WHEN op = 'remove' THEN 'remove' ELSE 'add' END AS op, e, a, v FROM log)"""
DATOMS = LOG + """, ev AS (SELECT t, e, a, v, max(CASE WHEN op = 'remove' THEN 'remove' ELSE 'add' END) AS op FROM log GROUP BY t, e, a, v),
settx AS (SELECT DISTINCT t, e, a FROM log WHERE op = 'set'),
spans AS (SELECT t, e, a, coalesce(lag(t) OVER (PARTITION BY e, a ORDER BY t), -1) AS since FROM settx),
live AS (SELECT s.t, s.e, s.a, ev.v, arg_max(ev.op, ev.t) AS op FROM spans s JOIN ev ON ev.e = s.e AND ev.a = s.a AND ev.t < s.t AND ev.t >= s.since GROUP BY s.t, s.e, s.a, ev.v),
datoms AS (SELECT t, CASE WHEN op = 'remove' THEN 'remove' ELSE 'add' END AS op, e, a, v FROM log
    UNION SELECT t, 'remove', e, a, v FROM live l WHERE op = 'add' AND NOT EXISTS (
        SELECT 1 FROM log s WHERE s.op = 'set' AND s.t = l.t AND s.e = l.e AND s.a = l.a AND s.v = l.v))"""
TRIPLES = """triples AS (SELECT CAST(c_custkey AS VARCHAR) AS e, unnest(['name', 'nation', 'segment']) AS a,
    unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS v FROM customer)"""
TOKENS = r"""list_filter(string_split(lower(regexp_replace(text, '[^\p{Latin}|0-9]', ' ', 'g')), ' '), lambda x: x <> '')"""


def squash_sql(source: str) -> str:
    """CTEs after which g has, for each triple of source, what its net effect depends on."""
    return f"""p AS (SELECT *, max(CASE WHEN op = 'set' THEN seq END) OVER (PARTITION BY e, a) AS sp FROM {source}),
    q AS (SELECT *, max(CASE WHEN seq = sp THEN v END) OVER (PARTITION BY e, a) AS sv FROM p),
    r AS (SELECT *, sp IS NOT NULL AND v = sv AS start FROM q WHERE sp IS NULL OR seq > sp OR (seq = sp AND v = sv)),
    s AS (SELECT *, max(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY e, a, v) AS la FROM r),
    g AS (SELECT e, a, v, bool_or(start) AS st, bool_or(op = 'add') AS ad,
        count(*) FILTER (op = 'remove' AND (la IS NULL OR seq > la)) AS k, count(*) FILTER (op = 'remove' AND seq < la) AS b FROM s GROUP BY e, a, v),
    net AS (SELECT 'add' AS op, e, a, v FROM g WHERE ad AND k = 0
    UNION ALL SELECT 'set', e, a, v FROM g WHERE st AND k = 0 AND (NOT ad OR b = 0)
    UNION ALL SELECT 'remove', e, a, v FROM g WHERE ((ad OR st) AND k > 0 AND k % 2 = 0) OR (NOT (ad OR st) AND k % 2 = 1))"""


def state_sql(n: int | None, source: str = "datoms") -> str:
    where = "" if n is None else f"WHERE t <= {n}"
    return f"(SELECT e, a, v FROM {source} {where} GROUP BY e, a, v HAVING arg_max(op, (t, op)) = 'add')"


# Conjunctive queries


@registered("SELECT c_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def bgp_region_customers(spark, d):
    return Q.query(
        [
            (relation(spark, d, "customer", ["c_custkey", "c_nationkey"]), ["?c", "?n"]),
            (relation(spark, d, "nation", ["n_nationkey", "n_regionkey"]), ["?n", "?r"]),
            (relation(spark, d, "region", ["r_regionkey", "r_name"]), ["?r", "ASIA"]),
        ]
    )


@registered(f"WITH {TRIPLES} SELECT x.e AS c, y.v AS name, z.v AS nation FROM triples x JOIN triples y ON y.e = x.e JOIN triples z ON z.e = x.e WHERE x.a = 'segment' AND x.v = 'BUILDING' AND y.a = 'name' AND z.a = 'nation'")
def bgp_self_join_eav(spark, d):
    eav = Index("eav", ["e", "a", "v"], customer_triples(spark, d))
    return Q.query([(eav, ["?c", "segment", "BUILDING"], ["?c", "name", "?name"], ["?c", "nation", "?nation"])])


@registered("SELECT c_custkey AS c, n_name AS name, CAST(7 AS INTEGER) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 7")
def bgp_seeded(spark, d):
    return Q.query([(relation(spark, d, "customer", ["c_custkey", "c_nationkey"]), ["?c", "?n"]), (relation(spark, d, "nation", ["n_nationkey", "n_name"]), ["?n", "?name"])], {"n": 7})


@registered("SELECT n_name AS n, r_name AS r FROM nation, region")
def bgp_cross_product(spark, d):
    return Q.query([(relation(spark, d, "nation", ["n_name"]), ["?n"]), (relation(spark, d, "region", ["r_name"]), ["?r"])])


@registered("SELECT c_nationkey AS x FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def bgp_scalar_join(spark, d):
    return Q.query([(relation(spark, d, "customer", ["c_nationkey"]), ["?x"]), (relation(spark, d, "supplier", ["s_nationkey"]), ["?x"])], spread=True)


# Patterns and scans


@registered("SELECT p_name AS name, p_size AS size FROM part WHERE starts_with(p_brand, 'Brand#1')")
def pattern_starts_with(spark, d):
    return relation(spark, d, "part", ["p_brand", "p_name", "p_size"]).substitutions([P.starts_with("Brand#1"), "?name", "?size"])


@registered("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def pattern_range_minimum(spark, d):
    return relation(spark, d, "orders", ["o_orderkey", "o_custkey"]).substitutions([P.Match(lambda c: c < 400, "k", 100), "?c"])


@registered("SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def pattern_predicate(spark, d):
    return relation(spark, d, "lineitem", ["l_returnflag", "l_orderkey", "l_quantity"]).substitutions(["R", "?k", P.Match(lambda c: c > 45, "q")])


@registered("SELECT l_linenumber AS n FROM lineitem WHERE l_orderkey = 3")
def pattern_prefix_bag(spark, d):
    return relation(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).substitutions([3, "?n"])


@registered("SELECT o_custkey AS customer, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
def pattern_rename(spark, d):
    return relation(spark, d, "orders", ["o_orderstatus", "o_custkey", "o_orderkey"]).substitutions(["F", P.rename("?o_custkey", "customer"), "?k"])


@registered("SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'A'")
def select_bag(spark, d):
    return relation(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]).select(["A", "?l_linestatus"])


@registered("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_unique(spark, d):
    return relation(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]).select_unique(["?l_returnflag", "?l_linestatus"])


@registered("SELECT DISTINCT l_suppkey FROM lineitem")
def unique_prefix(spark, d):
    return relation(spark, d, "lineitem", ["l_suppkey", "l_partkey"]).unique_prefix(1)


@registered("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 20")
def reverse_scan_limit(spark, d):
    return relation(spark, d, "orders", ["o_orderkey", "o_custkey"]).scan([500], reverse=True).limit(20)


@registered("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey > 5 OR (l_suppkey = 5 AND l_orderkey >= 100)")
def scan_from_row(spark, d):
    return relation(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber"]).scan([5, 100])


@registered("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 1")
def first_from_index(spark, d):
    return relation(spark, d, "customer", ["c_mktsegment", "c_custkey"]).first()


@registered("SELECT min(o_totalprice) AS neighbour FROM orders WHERE o_totalprice >= 1000")
def nearest_neighbour(spark, d):
    return relation(spark, d, "orders", ["o_totalprice"]).neighbour(1000, "ge")


# Joins


@registered("SELECT o_orderkey AS o, c.c AS c, s AS s FROM (SELECT o_orderkey, o_custkey AS c FROM orders) x JOIN (SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer) c ON x.c = c.c")
def loop_join_distinct(spark, d):
    subs = relation(spark, d, "orders", ["o_orderkey", "o_custkey"]).substitutions(["?o", "?c"])
    return Q.loop_join(relation(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_name"]), ["?c", "?s"], subs)


@registered("SELECT o_orderkey AS k, o_custkey AS c, l_linenumber AS n, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def merge_join_nway(spark, d):
    o = Index("orders", ["k", "c"], table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")))
    li = Index("lineitem", ["k", "n", "q"], table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")))
    return Q.merge_join([(o, ["?k", "?c"]), (li, ["?k", "?n", "?q"])])


@registered(f"WITH {TRIPLES} SELECT x.e AS start, min(n.n_name) AS value FROM triples x JOIN nation n ON x.a = 'nation' AND CAST(n.n_nationkey AS VARCHAR) = x.v GROUP BY x.e")
def value_path(spark, d):
    c = customer_triples(spark, d)
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("e"), F.lit("name").alias("a"), F.col("n_name").alias("v"))
    links = c.withColumn("v", F.when(F.col("a") == "nation", F.concat(F.lit("n"), F.col("v"))).otherwise(F.col("v")))
    return Q.value_path(links.unionByName(n), c.select("e").distinct(), ["nation", "name"])


@registered(f"WITH {LOG} SELECT DISTINCT e, a FROM log WHERE seq % 2 = 0 INTERSECT SELECT DISTINCT e, a FROM log WHERE seq % 2 = 1")
def property_conflicts(spark, d):
    log = event_log(spark, d)
    return T.property_conflicts(log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1"))


# Time


@registered(f"WITH {DATOMS} SELECT t, op, e, a, v FROM datoms")
def set_expansion(spark, d):
    return event_datoms(spark, d)


@registered(f"WITH {DATOMS} SELECT * FROM {state_sql(N)}")
def as_of_props(spark, d):
    return T.propositions(event_datoms(spark, d, N), N)


@registered(f"WITH {DATOMS} SELECT * FROM {state_sql(None)}")
def current_props(spark, d):
    return T.propositions(event_datoms(spark, d))


@registered(f"WITH {DATOMS} SELECT v FROM {state_sql(None)} WHERE e = 7 AND a = 'click'")
def current_values(spark, d):
    return T.values(event_datoms(spark, d), 7, "click")


@registered(f"WITH {DATOMS} SELECT min(v) AS v FROM {state_sql(None)} WHERE e = 7 AND a = 'click'")
def current_value(spark, d):
    return T.value(event_datoms(spark, d), 7, "click")


@registered(f"WITH {DATOMS} SELECT DISTINCT e FROM {state_sql(N)} WHERE a = 'click' AND v = 3")
def entities_by_value(spark, d):
    return T.entities(event_datoms(spark, d, N), "click", 3, N)


@registered(f"WITH {DATOMS} SELECT t, op, e, a, v FROM datoms WHERE e = 7 AND t <= {N}")
def history_for_entity(spark, d):
    return T.history(event_datoms(spark, d, N), 7, t=N)


@registered(f"WITH {DATOMS} SELECT t, op, e, a, v FROM datoms WHERE t BETWEEN 100 AND 200")
def history_between(spark, d):
    return T.between(event_datoms(spark, d, 200), 100, 200)


@registered(f"WITH {LOG}, s AS (SELECT *, coalesce(max(CASE WHEN op = 'set' THEN t END) OVER (PARTITION BY e, a), -1) AS since FROM log), k AS (SELECT t, CASE WHEN op = 'remove' THEN 'remove' ELSE 'add' END AS op, e, a, v FROM s WHERE t >= since) SELECT * FROM {state_sql(None, 'k')}")
def set_replaces_values(spark, d):
    return T.set_values(event_log(spark, d))


@registered(f"WITH {DATOMS} SELECT a, v, e, t, op FROM datoms")
def permuted_index(spark, d):
    return T.permuted(event_datoms(spark, d), "ave")


@registered(f"WITH {LOG}, {squash_sql('log')} SELECT op, e, a, v FROM net")
def squash_net_effect(spark, d):
    return T.squashed(event_log(spark, d))


@registered(f"WITH {DATOMS}, s AS {state_sql(None)} SELECT e, min(CASE WHEN a = 'click' THEN v END) AS click, min(CASE WHEN a = 'view' THEN v END) AS view FROM s GROUP BY e")
def entity_pivot(spark, d):
    return T.entity_pivot(T.propositions(event_datoms(spark, d)), ["click", "view"])


@registered(f"WITH {DATOMS} SELECT DISTINCT a FROM {state_sql(None)} WHERE e = 7")
def entity_attributes(spark, d):
    return T.attributes(T.propositions(event_datoms(spark, d)), 7)


# Derived indexes


def text_state(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("e"), F.lit("text").alias("a"), F.col("text").alias("v"))


@registered(f"SELECT DISTINCT 'text' AS a, unnest({TOKENS}) AS token, doc_id AS e FROM documents")
def full_text_state(spark, d):
    return views.full_text(text_state(spark, d))


@registered(f"SELECT DISTINCT token, e FROM (SELECT unnest({TOKENS}) AS token, doc_id AS e FROM documents) WHERE starts_with(token, 'th')")
def full_text_prefix_search(spark, d):
    term = P.starts_with("th", "token")
    index = Index("full_text", ["a", "token", "e"], views.full_text_search(text_state(spark, d), term.test))
    return index.substitutions(["text", term, "?e"])


@registered(
    f"""WITH o AS (SELECT DISTINCT doc_id AS e, unnest({TOKENS}) AS token FROM documents), m AS (SELECT DISTINCT e + 1 AS e, token FROM o WHERE e + 1 IN (SELECT doc_id FROM documents)),
    moved AS (SELECT doc_id + 1 AS e FROM documents)
    SELECT 'text' AS a, token, e, 'add' AS op FROM (SELECT e, token FROM m EXCEPT SELECT e, token FROM o)
    UNION ALL SELECT 'text', token, e, 'remove' FROM (SELECT e, token FROM o WHERE e IN (SELECT e FROM moved) EXCEPT SELECT e, token FROM m)"""
)
def full_text_delta_whole(spark, d):
    """Transaction 1 gives every document the text of the one before it, over all rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    base = docs.select(F.lit(0).cast("long").alias("t"), F.lit("add").alias("op"), F.col("doc_id").alias("e"), F.lit("text").alias("a"), F.col("text").alias("v"))
    moved = docs.select((F.col("doc_id") + 1).alias("e"), "text").join(docs.select(F.col("doc_id").alias("e")), "e")
    news = moved.select(F.lit(1).cast("long").alias("t"), F.lit("set").alias("op"), "e", F.lit("text").alias("a"), F.col("text").alias("v"))
    return views.full_text_delta(T.expanded_sets(base.unionByName(news)), 1)


@registered("SELECT DISTINCT unnest(list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT))) AS element, 'embedding' AS a, vec_id AS e FROM embeddings")
def sequence_members(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("e"), F.lit("embedding").alias("a"), F.transform("embedding", lambda x: F.floor(x * F.lit(10)).cast("long")).alias("v"))
    return views.sequence_members(rows)


@registered(f"WITH {DATOMS}, s AS {state_sql(N)} SELECT DISTINCT x.v AS c1, y.v AS c2, e FROM (SELECT e, v FROM s WHERE a IN ('click', 'view')) x JOIN (SELECT e, v FROM s WHERE a = 'purchase') y USING (e)")
def composite_cross(spark, d):
    state = T.propositions(event_datoms(spark, d, N), N)
    return views.composite(state, [("c1", ["click", "view"], None), ("c2", ["purchase"], None)])


@registered(f"WITH {PLAIN}, n AS (SELECT v AS value, t, sum(CASE WHEN op = 'remove' THEN -1 ELSE 1 END) AS net FROM plain WHERE a = 'click' GROUP BY v, t) SELECT value, t, CAST(sum(net) OVER (PARTITION BY value ORDER BY t) AS BIGINT) AS cnt FROM n")
def enumeration_counts(spark, d):
    return views.enumeration_counts(plain_datoms(spark, d), "click")


@registered(f"WITH {PLAIN} SELECT v AS value FROM plain WHERE a = 'click' AND t <= {N} GROUP BY v HAVING sum(CASE WHEN op = 'remove' THEN -1 ELSE 1 END) > 0")
def enumeration_live(spark, d):
    return views.enumeration_live(plain_datoms(spark, d), "click", N)


RULE_HEAD, RULE_BODY = ["?x", "?y"], [["?e", "click", "?x"], ["?e", "purchase", "?y"]]


def rule_sql(n: int) -> str:
    return f"(SELECT DISTINCT x.v AS x, y.v AS y FROM {state_sql(n)} x JOIN {state_sql(n)} y ON y.e = x.e WHERE x.a = 'click' AND y.a = 'purchase')"


@registered(f"WITH {DATOMS} SELECT * FROM {rule_sql(N)}")
def rule_view_state(spark, d):
    return views.rule(RULE_HEAD, RULE_BODY)(T.propositions(event_datoms(spark, d, N), N))


EARLY = 20  # early, while a transaction still changes the rule's few rows


@registered(f"WITH {DATOMS} SELECT x, y, 'add' AS op FROM (SELECT * FROM {rule_sql(EARLY)} EXCEPT SELECT * FROM {rule_sql(EARLY - 1)}) UNION ALL SELECT x, y, 'remove' FROM (SELECT * FROM {rule_sql(EARLY - 1)} EXCEPT SELECT * FROM {rule_sql(EARLY)})")
def rule_view_delta(spark, d):
    return views.delta(views.rule(RULE_HEAD, RULE_BODY), event_datoms(spark, d, EARLY), EARLY, by_entity=False)


# Branches


@registered(f"WITH {PLAIN} SELECT t, op, e, a, v FROM plain WHERE t <= {N} AND seq % 2 = 0 UNION ALL SELECT t + {N} + 1, op, e, a, v FROM plain WHERE seq % 2 = 1")
def merged_history(spark, d):
    p = plain_datoms(spark, d)
    return branch.merged(p.filter("seq % 2 = 0").drop("seq"), p.filter("seq % 2 = 1").drop("seq"), N)


@registered(f"WITH {PLAIN}, m AS (SELECT t, op, e, a, v FROM plain WHERE t <= {N} AND seq % 2 = 0 UNION ALL SELECT t + {N} + 1, op, e, a, v FROM plain WHERE seq % 2 = 1) SELECT * FROM {state_sql(None, 'm')}")
def branch_overlay(spark, d):
    p = plain_datoms(spark, d).drop("seq")
    q = plain_datoms(spark, d)
    return branch.branch_state(q.filter("seq % 2 = 0").drop("seq"), q.filter("seq % 2 = 1").drop("seq"), N, p.columns[2:])


# Changes


@registered(f"WITH {TRIPLES} SELECT 'remove' AS op, e, a, v FROM triples WHERE e = '7' OR v = '7'")
def remove_entity_changes(spark, d):
    return changes.remove_entity(customer_triples(spark, d), "7")


@registered(f"WITH {TRIPLES} SELECT 'remove' AS op, e, a, v FROM triples WHERE a = 'segment' UNION ALL SELECT 'add', e, 'market', v FROM triples WHERE a = 'segment'")
def rename_attribute_changes(spark, d):
    return changes.change_attribute(customer_triples(spark, d), None, "segment", "market")


@registered("SELECT 'remove' AS op, vec_id AS e, 'embedding' AS a, array_to_string(vs, ',') AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT)) AS vs FROM embeddings) WHERE list_contains(vs, 1) UNION ALL SELECT 'add', vec_id, 'embedding', array_to_string(list_filter(vs, lambda x: x <> 1), ',') FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT)) AS vs FROM embeddings) WHERE list_contains(vs, 1)")
def sequence_reference_changes(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("e"), F.lit("embedding").alias("a"), F.transform("embedding", lambda x: F.floor(x * F.lit(10)).cast("long")).alias("v"))
    return changes.remove_sequence_references(rows, 1).withColumn("v", F.concat_ws(",", F.col("v").cast("array<string>")))


TREE = "edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def tree_triples(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("e"), F.lit("part").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("v"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("e"), F.lit("part").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("v"))
    return n.unionByName(c)


@registered(f"WITH RECURSIVE {TREE}, below(root, e) AS (SELECT parent, child FROM edges WHERE parent LIKE 'r%' UNION SELECT b.root, x.child FROM below b JOIN edges x ON x.parent = b.e) SELECT root, e FROM below")
def component_closure(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("e"))
    return changes.subcomponents(tree_triples(spark, d), ["part"], roots)


@registered(f"WITH RECURSIVE {TREE}, below(e) AS (SELECT 'r2' UNION SELECT x.child FROM below b JOIN edges x ON x.parent = b.e) SELECT DISTINCT 'remove' AS op, parent AS e, 'part' AS a, child AS v FROM edges WHERE parent IN (SELECT e FROM below) OR child IN (SELECT e FROM below)")
def cascade_delete_changes(spark, d):
    roots = spark.createDataFrame([("r2",)], "e string")
    return changes.remove_component_tree(tree_triples(spark, d), ["part"], roots)


@registered(f"WITH {TREE} SELECT child AS node FROM edges WHERE child NOT IN (SELECT parent FROM edges)")
def tree_leaves(spark, d):
    edges = tree_triples(spark, d).select(F.col("e").alias("parent"), F.col("v").alias("child"), F.lit(0).alias("position"))
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.leaves(edges, roots).select("node")


# Shredding and ids


@registered(f"WITH {TRIPLES} SELECT e, a, v FROM triples")
def shred_records(spark, d):
    return customer_triples(spark, d)


@registered("SELECT DISTINCT 'add' AS op, CAST(o_orderkey AS VARCHAR) AS e, 'status' AS a, o_orderstatus AS v FROM orders UNION SELECT 'add', CAST(l_orderkey AS VARCHAR), 'lines', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION SELECT 'add', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def shred_nested(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"))).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return shred.shredded(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "lines"), "id")


@registered("WITH c AS (SELECT o_orderkey AS seq, 'tmp/' || o_custkey AS e FROM orders), f AS (SELECT e AS tmp, min(seq) AS s FROM c GROUP BY e) SELECT tmp, CAST(row_number() OVER (ORDER BY s) + 99 AS VARCHAR) AS id FROM f")
def temp_ids(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("tmp/"), "o_custkey").alias("e"), F.col("o_orderstatus").alias("v"))
    return shred.temporary_ids(rows, 100)


# Reducers


@registered("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM events")
def with_index(spark, d):
    return reducers.with_index(table(spark, d, "events").select("event_id", "user_id"), ["event_id"])


@registered("SELECT event_id, value FROM events WHERE event_id <= (SELECT min(event_id) FROM events WHERE value > 99)")
def take_up_to(spark, d):
    return reducers.take_up_to(table(spark, d, "events").select("event_id", "value"), F.col("value") > 99, "event_id")


@registered("SELECT max_by(value, event_id) AS value FROM events")
def last_value(spark, d):
    return reducers.last_value(table(spark, d, "events"), "value", "event_id")


@registered("SELECT count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS max, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents")
def size_report(spark, d):
    return reducers.size_report(table(spark, d, "documents"), "n_chars")


@registered("WITH c AS (SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 1) SELECT value, count, row_number() OVER (ORDER BY -count, value) - 1 AS code FROM c")
def frequency_codes(spark, d):
    return reducers.frequency_codes(table(spark, d, "customer"), "c_mktsegment")


@registered(
    """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    r AS (SELECT source, doc_id, n_chars, k, CAST(0 AS BIGINT) AS batch, CAST(n_chars AS BIGINT) AS filled FROM o WHERE k = 1
    UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.k, CASE WHEN r.filled + o.n_chars > 100000 THEN r.batch + 1 ELSE r.batch END,
        CASE WHEN r.filled + o.n_chars > 100000 THEN o.n_chars ELSE r.filled + o.n_chars END FROM r JOIN o ON o.source IS NOT DISTINCT FROM r.source AND o.k = r.k + 1)
    SELECT source, doc_id, n_chars, batch FROM r"""
)
def partition_by_size(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return reducers.partition_by_size(rows, "source", "doc_id", "n_chars", 100_000)


# Scalars


@registered(
    """SELECT c_custkey AS k, sha256(c_name) AS sha256, to_base64(encode(c_name)) AS b64, lower(hex(encode(c_name))) AS b16,
    CASE WHEN length(lower(to_hex(c_nationkey))) < 2 THEN lpad(lower(to_hex(c_nationkey)), 2, '0') ELSE lower(to_hex(c_nationkey)) END AS hexed,
    substr(c_name, 1, 5) AS cut, bin(c_custkey) AS bits, CAST(length(bin(c_custkey)) AS INTEGER) AS n_bits, c_nationkey & 255 AS low FROM customer"""
)
def scalar_functions(spark, d):
    name, key, nation = F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        key.alias("k"),
        scalars.sha256(name).alias("sha256"),
        scalars.base64_encode(F.encode(name, "utf-8")).alias("b64"),
        scalars.base16_encode(F.encode(name, "utf-8")).alias("b16"),
        scalars.hexify(nation).alias("hexed"),
        scalars.cut(name, 5).alias("cut"),
        scalars.bits(key).alias("bits"),
        scalars.bit_count(key).alias("n_bits"),
        scalars.unsigned_byte(nation).alias("low"),
    )


@registered(
    """WITH v AS (SELECT 7 AS k, CAST(c_acctbal AS DOUBLE) AS num, NULL AS str, c_custkey AS id FROM customer
    UNION ALL SELECT 8, NULL, c_name, c_custkey FROM customer UNION ALL SELECT 0, NULL, NULL, c_custkey FROM customer)
    SELECT id, k, row_number() OVER (ORDER BY k, num NULLS FIRST, str NULLS FIRST, id) - 1 AS place FROM v"""
)
def value_order(spark, d):
    """Numbers, strings and nulls in one total order."""
    c = table(spark, d, "customer")
    each = [c.select(F.col("c_custkey").alias("id"), f.alias("v")) for f in (values.number(F.col("c_acctbal")), values.string(F.col("c_name")), values.null_value())]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return reducers.with_index(rows, ["v", "id"], "place").select("id", F.col("v.k").cast("int").alias("k"), "place")


# More reducers, scans and joins


@registered("SELECT count(*) AS count FROM lineitem")
def count_rows(spark, d):
    return reducers.count_rows(table(spark, d, "lineitem"))


@registered("SELECT min_by(value, event_id) AS value FROM events")
def first_value(spark, d):
    return reducers.first_value(table(spark, d, "events"), "value", "event_id")


@registered("SELECT event_id, value FROM events WHERE value > 99 ORDER BY event_id LIMIT 1")
def find_first(spark, d):
    return reducers.find_first(table(spark, d, "events").select("event_id", "value"), F.col("value") > 99, "event_id")


@registered("SELECT event_id, value FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE value >= 90), 9e18) UNION ALL SELECT * FROM (SELECT event_id, value FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE value >= 90) ORDER BY event_id LIMIT 5)")
def take_while_and_more(spark, d):
    return reducers.take_while_and_more(table(spark, d, "events").select("event_id", "value"), F.col("value") < 90, "event_id", 5)


@registered("SELECT 'gt' AS kind, min(o_totalprice) AS neighbour FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'lt', max(o_totalprice) FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT 'le', max(o_totalprice) FROM orders WHERE o_totalprice <= 1000")
def nearest_neighbours(spark, d):
    index = relation(spark, d, "orders", ["o_totalprice"])
    rows = [index.neighbour(1000, kind).select(F.lit(kind).alias("kind"), "neighbour") for kind in ("gt", "lt", "le")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@registered("SELECT n_nationkey AS n, n_name AS name, c_custkey AS c, s_suppkey AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey")
def merge_join_three(spark, d):
    parts = [("nation", [("n", "n_nationkey"), ("name", "n_name")]), ("customer", [("n", "c_nationkey"), ("c", "c_custkey")]), ("supplier", [("n", "s_nationkey"), ("s", "s_suppkey")])]
    return Q.merge_join([(Index(t, [n for n, _ in cs], table(spark, d, t).select(*[F.col(c).alias(n) for n, c in cs])), [f"?{n}" for n, _ in cs]) for t, cs in parts], spread=True)


# More of time, branches and commits


@registered(f"WITH {LOG} SELECT e, a, CASE WHEN arg_max(op, seq) = 'set' THEN arg_max(v, seq) END AS v FROM log GROUP BY e, a")
def last_set_value(spark, d):
    return T.last_set_value(event_log(spark, d))


UP, DOWN = f"t <= {N} AND seq % 2 = 0", "seq % 2 = 1"  # a log as two: a branch's base and its own transactions
MERGED = LOG.replace("log AS", "whole AS", 1) + f", log AS (SELECT t, seq, op, e, a, v FROM whole WHERE {UP} UNION ALL SELECT t + {N} + 1, seq, op, e, a, v FROM whole WHERE {DOWN})"


@registered(f"WITH {DATOMS.replace(LOG, MERGED)} SELECT * FROM {state_sql(None)}")
def overlay_state(spark, d):
    """A client's uncommitted transactions on a pinned database."""
    log = event_log(spark, d)
    base = database.Database(log.filter("seq % 2 = 0"), t=N)
    return database.Overlay(base, database.Database(log.filter("seq % 2 = 1"))).state()


@registered(f"WITH {LOG}, base AS (SELECT * FROM log WHERE {UP}), own AS (SELECT * FROM log WHERE {DOWN}), {squash_sql('own')} SELECT t, seq, op, e, a, v FROM base UNION ALL SELECT (SELECT max(t) FROM base) + 1, 0, op, e, a, v FROM net")
def branch_commit(spark, d):
    """The branch's net effect as one more transaction of its base."""
    log = event_log(spark, d)
    return branch.squashed_commit(log.filter(UP), log.filter(DOWN))


@registered(f"WITH {DATOMS} SELECT * FROM {state_sql(None)}")
def snapshot_and_tail(spark, d):
    """A stored snapshot as of a transaction, and the log behind it."""
    log, path = event_log(spark, d), own_folder(spark, "snapshots")
    logs.store_snapshot(T.propositions(event_datoms(spark, d, N), N), path, N)
    t, stored = logs.latest_snapshot(spark, path)
    facts = stored.select(F.lit(t).cast("long").alias("t"), F.lit(0).cast("long").alias("seq"), F.lit("add").alias("op"), "e", "a", "v")
    return T.propositions(T.expanded_sets(branch.with_tail(facts, t, log)))


@registered(f"WITH {PLAIN} SELECT t, op, 'up' AS stream, e, a, v FROM plain WHERE {UP} UNION ALL SELECT t + {N} + 1, op, CASE WHEN e % 3 = 0 THEN 'up' ELSE 'down' END, e, a, v FROM plain WHERE {DOWN}")
def merged_streams(spark, d):
    """Ids are local to their stream unless they say where they are from."""
    p = plain_datoms(spark, d)
    named = lambda stream: F.struct(stream.cast("string").alias("stream_id"), F.col("e").alias("id"))
    up = p.filter("seq % 2 = 0").withColumn("e", named(F.lit(None)))
    down = p.filter("seq % 2 = 1").withColumn("e", named(F.when(F.col("e") % 3 == 0, "up")))
    return branch.merged_streams(up, "up", down, "down", N, ["e"]).select("t", "op", F.col("e.stream_id").alias("stream"), F.col("e.id").alias("e"), "a", "v")


@registered(f"WITH {LOG} SELECT t, CAST(seq AS INTEGER) AS seq, op, CAST(e AS VARCHAR) AS e, a, CAST(v AS VARCHAR) AS v FROM log WHERE t < {N}")
def log_recovery(spark, d):
    """A log of JSON lines, one of which was cut off."""
    log, path = event_log(spark, d), own_folder(spark, "log")
    line = F.to_json(F.struct("t", F.col("seq").cast("int").alias("seq"), "op", F.col("e").cast("string").alias("e"), "a", F.col("v").cast("string").alias("v")))
    lines = log.repartitionByRange("seq").sortWithinPartitions("seq")
    lines.select(F.when(F.col("seq") == 10 * N + 5, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return logs.read_json(spark, path)


@registered(f"WITH {DATOMS} SELECT DISTINCT v, e FROM {state_sql(None)} WHERE a = 'purchase'")
def stored_view(spark, d):
    """A view that is stored and kept up with its log in two steps."""
    path = own_folder(spark, "store")
    log = event_log(spark, d)
    logs.append(log.select("t", F.col("seq").cast("int").alias("seq"), "op", "e", "a", "v"), f"{path}/log")
    kept = store.Store(spark, path, {"bought": (["v", "e"], lambda s: s.filter("a = 'purchase'").select("v", "e"), True)})
    kept.catch_up("bought", N)
    kept.catch_up("bought")
    return kept.view("bought")


def nation_commits(spark, d):
    """A commit for each nation, on top of the one at half its number."""
    n = F.col("n_nationkey").cast("int")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    parents = F.when(n > 0, F.array(name(F.floor((n - 1) / 2)))).otherwise(F.array().cast("array<string>"))
    statement = lambda op, e: F.struct(F.lit(op).alias("op"), e.alias("e"), F.lit("name").alias("a"), F.col("n_name").alias("v"))
    return table(spark, d, "nation").select(name(n).alias("hash"), parents.alias("parents"), F.array(statement("add", name(n)), statement("set", F.lit("latest"))).alias("statements"))


HEAP = "up(tip, n, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT tip, (n - 1) // 2, depth + 1 FROM up WHERE n > 0)"


@registered(f"WITH RECURSIVE {HEAP} SELECT CASE tip WHEN 15 THEN 'ours' ELSE 'theirs' END AS side, 'n' || n AS hash FROM up WHERE tip IN (15, 20) AND n NOT IN (SELECT n FROM up WHERE tip = 1)")
def novel_commits(spark, d):
    return graph.novel_commits(nation_commits(spark, d), spark, "n1", "n15", "n20")


@registered(f"WITH RECURSIVE {HEAP}, seen AS (SELECT n, CAST(max(depth) OVER () - depth AS BIGINT) AS t FROM up WHERE tip = 24) SELECT t, s AS seq, CASE s WHEN 0 THEN 'add' ELSE 'set' END AS op, CASE s WHEN 0 THEN 'n' || n ELSE 'latest' END AS e, 'name' AS a, n_name AS v FROM seen JOIN nation ON n_nationkey = n, (VALUES (0), (1)) x(s)")
def commit_log(spark, d):
    return graph.commit_log(nation_commits(spark, d).select("hash", "parents", "statements"), "n24")


@registered(f"WITH RECURSIVE {HEAP} SELECT 'n' || n AS hash, max(depth) OVER () - depth AS place FROM up WHERE tip = 22")
def first_parents(spark, d):
    return graph.first_parents(nation_commits(spark, d), "n22")


@registered(f"WITH {TREE}, n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 1 ELSE 0 END AS level FROM nation) SELECT node, level FROM n UNION ALL SELECT 'c' || c_custkey, 0 FROM customer UNION ALL SELECT 'r' || r_regionkey, coalesce((SELECT max(level) + 1 FROM n WHERE up = 'r' || r_regionkey), 0) FROM region")
def topological_levels(spark, d):
    edges = tree_triples(spark, d).select(F.col("e").alias("parent"), F.col("v").alias("child"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.topological_levels(edges, regions.unionByName(edges.select(F.col("child").alias("node"))))


ELEMENTS = "list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT))"


@registered(
    f"""WITH o AS (SELECT DISTINCT vec_id AS e, unnest({ELEMENTS}) AS element FROM embeddings), m AS (SELECT DISTINCT e + 1 AS e, element FROM o WHERE e + 1 IN (SELECT vec_id FROM embeddings)), moved AS (SELECT vec_id + 1 AS e FROM embeddings)
    SELECT element, 'embedding' AS a, e, 'add' AS op FROM (SELECT e, element FROM m EXCEPT SELECT e, element FROM o)
    UNION ALL SELECT element, 'embedding', e, 'remove' FROM (SELECT e, element FROM o WHERE e IN (SELECT e FROM moved) EXCEPT SELECT e, element FROM m)"""
)
def sequence_delta(spark, d):
    """Transaction 1 gives every vector the elements of the one before it."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(10)).cast("long")).alias("v"))
    base = rows.select(F.lit(0).cast("long").alias("t"), F.lit("add").alias("op"), F.col("vec_id").alias("e"), F.lit("embedding").alias("a"), "v")
    moved = rows.select((F.col("vec_id") + 1).alias("e"), "v").join(rows.select(F.col("vec_id").alias("e")), "e")
    news = moved.select(F.lit(1).cast("long").alias("t"), F.lit("set").alias("op"), "e", F.lit("embedding").alias("a"), "v")
    return views.sequence_delta(T.expanded_sets(base.unionByName(news)), 1)


@registered("SELECT CAST(p_partkey AS VARCHAR) AS e, 'word' AS a, unnest(string_split(p_name, ' ')) AS v FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_brand', p_brand FROM part")
def shred_multivalued(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return shred.triples_from_columns(parts, "p_partkey", multivalued={"p_name": " "}, rename={"p_name": "word"})


@registered("SELECT c_custkey AS k, lower(to_hex(2000 + c_nationkey)) AS year_hex, list_resize([c_nationkey, c_custkey], 3, 0) AS three, to_hex(c_custkey % 128) AS low FROM customer")
def binary_forms(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    date = F.make_date(F.lit(2000) + nation, F.lit(5), F.lit(7))
    return table(spark, d, "customer").select(
        key.alias("k"),
        F.lower(F.ltrim(F.substring(F.hex(scalars.date_bytes(date)), 1, 4), F.lit("0"))).alias("year_hex"),
        scalars.padded(F.array(nation, key), 3, F.lit(0).cast("long")).alias("three"),
        F.hex(scalars.leb128_values(scalars.leb128_sequence(F.array(key % 128)))[0]).alias("low"),
    )
