"""Registered queries over the deductive engine, with equivalent SQL.

Each program binds whole tables as facts. Two graphs are made of them: in the order graph each order has an edge to the next
order of its customer, and the last one to the first, so that each customer has a ring; in the nation graph a customer's
nation has an edge to each nation that supplies it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.database import Database
from stratalog.functions.callbacks import Expand, Filter

#: Declaration, table, columns, and the fields that are its key.
PREDICATES = {
    "Region": ("Region{key: i32, name: String}", "region", {"key": "r_regionkey", "name": "r_name"}, ("key",)),
    "Nation": ("Nation{key: i32, name: String, region: i32}", "nation", {"key": "n_nationkey", "name": "n_name", "region": "n_regionkey"}, ("key",)),
    "Customer": ("Customer{key: i64, nation: i32, segment: String}", "customer", {"key": "c_custkey", "nation": "c_nationkey", "segment": "c_mktsegment"}, ("key",)),
    "Supplier": ("Supplier{key: i64, nation: i32}", "supplier", {"key": "s_suppkey", "nation": "s_nationkey"}, ("key",)),
    "Orders": ("Orders{key: i64, cust: i64, status: String, priority: String}", "orders", {"key": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority"}, ("key",)),
    "Line": ("Line{okey: i64, part: i64, supp: i64, qty: f64}", "lineitem", {"okey": "l_orderkey", "part": "l_partkey", "supp": "l_suppkey", "qty": "l_quantity"}, ()),
    "L": ("L(i64, i64, i64)", "lineitem", {"arg0": "l_partkey", "arg1": "l_orderkey", "arg2": "l_suppkey"}, ()),
    "Event": ("Event{id: i64, user: i64, kind: String}", "events", {"id": "event_id", "user": "user_id", "kind": "event_type"}, ("id",)),
    "Turn": ("Turn{conv: i64, turn: i64, role: String}", "conversations", {"conv": "conv_id", "turn": "turn", "role": "role"}, ()),
}


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = Window.partitionBy("o_custkey")
    after = F.coalesce(F.lead("o_orderkey").over(own.orderBy("o_orderkey")), F.min("o_orderkey").over(own))
    return orders.select(F.col("o_orderkey").alias("a"), after.alias("b"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation graph."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "lineitem", "supplier")}
    joined = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).distinct()


RINGS_SQL = "SELECT o_orderkey AS a, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), min(o_orderkey) OVER (PARTITION BY o_custkey)) AS b FROM orders"
NATIONS_SQL = "SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey"


def database(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...] = (), graph: Callable[[SparkSession, str], DataFrame] | None = None, more: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None, **options: Any) -> Database:
    """A database of ``text`` and the named predicates, bound to their tables."""
    lines = [PREDICATES[t][0] for t in tables] + (["edge(i64, i64)"] if graph else [])
    db = Database(spark, "\n".join([*lines, text]), **options)
    for t in tables:
        _, name, mapping, key = PREDICATES[t]
        db.bind(t, spark.read.parquet(f"{sf_dir}/{name}.parquet"), mapping, key)
    if graph:
        db.bind("edge", graph(spark, sf_dir), {"arg0": "a", "arg1": "b"})
    for pred, make in (more or {}).items():
        db.insert(pred, make(spark, sf_dir))
    return db


def asked(text: str, *tables: str, graph: Callable[[SparkSession, str], DataFrame] | None = None, run: bool = False, **options: Any) -> Callable[[SparkSession, str], DataFrame]:
    """A query that returns ``?q`` of a program, after its rules if ``run``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, text, tables, graph, **options)
        if run:
            db.run_rules()
        return db.query("q")

    return query


PATHS = "path(i64, i64)\n?q: path(x, y)\none: path(x, y) <- edge(x, y)\nmore: path(x, z) <- edge(x, y) & path(y, z)"
MUTUAL = PATHS.replace("?q: path(x, y)", "both(i64, i64)\n?q: both(x, y)\nthere_and_back: both(x, y) <- path(x, y) & path(y, x)")
TURNS = "Next{conv: i64, a: i64, b: i64}\nReach{conv: i64, a: i64, b: i64}\n?q: Reach{conv: c, a: a, b: b}\nstep: Next{conv: c, a: a, b: b} <- Turn{conv: c, turn: a} & Turn{conv: c, turn: b} + after\nfirst: Reach{conv: c, a: a, b: b} <- Next{conv: c, a: a, b: b}\nmore: Reach{conv: c, a: a, b: d} <- Reach{conv: c, a: a, b: b} & Next{conv: c, a: b, b: d}"


def self_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusions that change the very group that they rest on, and fall when a fact of it is told again.

    The facts told are the keys of the region of key 0, step by step.
    """
    text = "Stock(i64^sum)\nCall(i64^sum)\nAlarm(i64^sum)\n?stock: Stock(n)\n?alarm: Alarm(n)\nrefill: Stock(~(3)) <- ~Stock(~(0))\nquiet: Alarm(~(0)) <- ~Call(~(0))\nraised: Alarm(~(4)) <- ~Alarm(~(0))"
    db = Database(spark, text)
    zero = spark.read.parquet(f"{sf_dir}/region.parquet").filter("r_regionkey = 0").select("r_regionkey")
    out = None
    for step, pred in enumerate(("Stock", "Call", "Call")):
        db.insert(pred, zero, {"arg0": "r_regionkey"})
        db.run_rules()
        for name in ("stock", "alarm"):
            one = db.query(name).select(F.lit(step).alias("step"), F.lit(name).alias("pred"), F.col("n").cast("int").alias("value"))
            out = one if out is None else out.union(one)
    return out


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins that are new after the second half of the orders came."""
    db = database(spark, sf_dir, PREDICATES["Orders"][0] + "\n?q: Orders{key: k, cust: c, status: ~(\"F\")} & Customer{key: c, nation: n}", ("Customer",))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for half in (0, 1):
        db.insert("Orders", orders.filter(F.col("o_orderkey") % 2 == half), PREDICATES["Orders"][2])
        new = db.query_incr("q")
    return new


def derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule derives a path between nations."""
    db = database(spark, sf_dir, PATHS, graph=nations, provenance=True)
    db.run_rules()
    return db.provenance("path").groupBy("rule").agg(F.count("*").alias("derivations"), F.countDistinct("fid").alias("facts"))


def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order: a false default for each customer, true where there is such an order."""
    text = "Has{cust: i64, any: bool^or}\nCalm(i64)\n?q: Calm(c)\na: Has{cust: c, any: ~false} <- Customer{key: c}\nb: Has{cust: c, any: ~true} <- Orders{cust: c, priority: ~P}\nc@1: Calm(c) <- ~Has{cust: c, any: ~false}"
    return asked(text, "Customer", "Orders", run=True, constants={"P": "1-URGENT"})(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_project": asked("?q: Nation{key: k, name: n}", "Nation"),
    "ordered_wildcard": asked("?q: L(p, _, s)", "L"),
    "const_filter": asked("?q: Nation{key: k, region: ~ONE}", "Nation", constants={"ONE": 1}),
    "expr_const": asked("?q: Nation{key: k, region: ~(1 + 1)}", "Nation"),
    "float_const": asked("?q: Line{okey: o, part: p, qty: ~(7.0 / 2.0 + 1.5f64)}", "Line"),
    "remainder_const": asked("?q: Nation{key: k, region: ~(-7 / 2 + -7 % 2 + 5u8)}", "Nation"),
    "string_const": asked("?q: Orders{key: k, status: ~(\"F\"), priority: ~(\"1-\" + \"URGENT\")}", "Orders"),
    "qualified_const": asked("?q: Nation{key: k, region: ~ns::TWO}", "Nation", constants={"ns::TWO": 2}),
    "out_of_range_const": asked("?q: Nation{key: k, region: ~std::u64::MAX}", "Nation"),
    "self_equal": asked("?q: L(x, o, x)", "L"),
    "ground": asked("?q: Nation{key: ~ZERO}", "Nation", constants={"ZERO": 0}),
    "exists_clause": asked("?q: Nation{key: k} & Event{kind: ~ERR}", "Nation", "Event", constants={"ERR": "error"}),
    "join2": asked("?q: Customer{key: c, nation: n} & Nation{key: n, name: name}", "Customer", "Nation"),
    "join3": asked("?q: Orders{key: o, cust: c, status: ~(\"F\")} & Customer{key: c, nation: n} & Nation{key: n, name: name}", "Orders", "Customer", "Nation"),
    "multi_key": asked("?q: Customer{key: c, nation: n} & Orders{key: o, cust: c} & Line{okey: o, supp: s} & Supplier{key: s, nation: n}", "Customer", "Orders", "Line", "Supplier"),
    "self_join": asked("?q: Nation{key: a, region: r} & Nation{key: b, region: r}", "Nation"),
    "triangle": asked("?q: edge(x, y) & edge(y, z) & edge(z, x)", graph=rings),
    "cross": asked("Seg(String)\n?q: Region{name: r} & Seg(s)\nseg: Seg(s) <- Customer{segment: s}", "Region", "Customer", run=True),
    "semi": asked("Urgent(i64)\n?q: Urgent(c)\nu: Urgent(c) <- Customer{key: c} & Orders{key: _, cust: c, priority: ~P}", "Customer", "Orders", run=True, constants={"P": "1-URGENT"}),
    "head_constant": asked("Tag{key: i32, tag: String}\n?q: Tag{key: k, tag: t}\nt: Tag{key: k, tag: ~(\"seen\")} <- Nation{key: k}", "Nation", run=True),
    "head_duplicate": asked("Pair(i32, i32)\n?q: Pair(x, y)\nd: Pair(k, k) <- Nation{key: k}", "Nation", run=True),
    "anti": anti,
    "sum_group": asked("Tot{part: i64, qty: f64^sum}\n?q: Tot{part: p, qty: q}\nt: Tot{part: p, qty: q} <- Line{part: p, qty: q}", "Line", run=True),
    "multi_agg": asked("T{part: i64, lo: f64^min, hi: f64^max}\n?q: T{part: p, lo: lo, hi: hi}\nt: T{part: p, lo: q, hi: q} <- Line{part: p, qty: q}", "Line", run=True),
    "user_agg": asked("T{part: i64, top: f64^top}\n?q: T{part: p, top: q}\nt: T{part: p, top: q} <- Line{part: p, qty: q}", "Line", run=True, aggregators={"top": max}),
    "array_agg": asked("Kinds{user: i64, kinds: Vs^set_union}\n?q: Kinds{user: u, kinds: k}\nk: Kinds{user: u, kinds: a} <- Event{user: u, kind: e} + one", "Event", run=True, types={"Vs": "array<string>"}, callbacks={"one": Expand(lambda v: F.array(F.struct(F.array(v["e"]).alias("a"))))}),
    "having": asked("Tot{part: i64, qty: f64^sum}\n?q: Tot{part: p, qty: ~(575.0)}\nt: Tot{part: p, qty: q} <- Line{part: p, qty: q}", "Line", run=True),
    "global_agg": asked("Top(i64^max)\n?q: Top(x)\nt: Top(x) <- Event{id: x}", "Event", run=True),
    "global_agg_empty": asked("Top(i64^max)\n?q: Top(x)\nt: Top(x) <- Event{id: x, kind: ~(\"none\")}", "Event", run=True),
    "union_rules": asked("N(i32)\n?q: N(x)\na: N(x) <- Customer{nation: x}\nb: N(x) <- Supplier{nation: x}", "Customer", "Supplier", run=True),
    "intersect": asked("N(i32)\n?q: N(x)\na: N(x) <- Customer{nation: x} & Supplier{nation: x}", "Customer", "Supplier", run=True),
    "closure": asked(PATHS, graph=rings, run=True),
    "clique": asked(MUTUAL, graph=rings, run=True),
    "turn_chain": asked(TURNS, "Turn", run=True, callbacks={"after": Filter(lambda v: v["b"] == v["a"] + 1)}),
    "nonlinear": asked("reach(i64, i64)\n?q: reach(x, y)\na: reach(x, y) <- edge(x, y)\nb: reach(x, z) <- reach(x, y) & reach(y, z)", graph=rings, run=True),
    "mutual_recursion": asked("odd(i64, i64)\neven(i64, i64)\n?q: even(x, y)\na: odd(x, y) <- edge(x, y)\nb: even(x, z) <- odd(x, y) & edge(y, z)\nc: odd(x, z) <- even(x, y) & edge(y, z)", graph=rings, run=True),
    "staged": asked("Cnt{nation: i32, n: i64^max}\nBest(i64^max)\n?q: Best(b)\na@0: Cnt{nation: n, n: c} <- Customer{key: c, nation: n}\nb@1: Best(c) <- ~Cnt{nation: _, n: c}", "Customer", run=True),
    "callback_flat": asked("Letter(String)\n?q: Letter(l)\na: Letter(l) <- Nation{name: n} + letters", "Nation", run=True, callbacks={"letters": lambda r: [{"l": c} for c in r["n"]]}),
    "callback_filter": asked("Big(i64)\n?q: Big(k)\na: Big(k) <- Customer{key: k} + m::big", "Customer", run=True, callbacks={"m::big": Filter(lambda v: v["k"] > 100)}),
    "circumscribe_final": asked("Tot{part: i64, qty: f64^sum}\nFlag(i64)\n?q: Flag(p)\na@0: Tot{part: p, qty: q} <- Line{part: p, qty: q}\nb@1: Flag(p) <- ~Tot{part: p, qty: ~(575.0)}", "Line", run=True),
    "self_support": self_support,
    "incr_delta": incremental,
    "derivation": derivation,
}

_REACH = "reach(x, y) AS (SELECT a, b FROM edge UNION SELECT e.a, r.y FROM edge e JOIN reach r ON e.b = r.x)"
_WITH = f"WITH RECURSIVE edge AS ({RINGS_SQL})"

ORACLE: dict[str, str] = {
    "scan_project": "SELECT DISTINCT n_nationkey AS k, n_name AS n FROM nation",
    "ordered_wildcard": "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem",
    "const_filter": "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey = 1",
    "expr_const": "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey = 2",
    "float_const": "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity = 5",
    "remainder_const": "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey = 1",
    "string_const": "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "qualified_const": "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey = 2",
    "out_of_range_const": "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 18446744073709551615",
    "self_equal": "SELECT DISTINCT l_partkey AS x, l_orderkey AS o FROM lineitem WHERE l_partkey = l_suppkey",
    "ground": "SELECT true AS holds WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0)",
    "exists_clause": "SELECT DISTINCT n_nationkey AS k FROM nation WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error')",
    "join2": "SELECT DISTINCT c_custkey AS c, c_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join3": "SELECT DISTINCT o_orderkey AS o, c_custkey AS c, c_nationkey AS n, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    "multi_key": "SELECT DISTINCT c_custkey AS c, c_nationkey AS n, o_orderkey AS o, s_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey",
    "self_join": "SELECT DISTINCT x.n_nationkey AS a, x.n_regionkey AS r, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey",
    "triangle": f"WITH e AS ({RINGS_SQL}) SELECT p.a AS x, p.b AS y, q.b AS z FROM e p JOIN e q ON p.b = q.a JOIN e r ON q.b = r.a AND r.b = p.a",
    "cross": "SELECT r, s FROM (SELECT DISTINCT r_name AS r FROM region), (SELECT DISTINCT c_mktsegment AS s FROM customer)",
    "semi": "SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "head_constant": "SELECT DISTINCT n_nationkey AS k, 'seen' AS t FROM nation",
    "head_duplicate": "SELECT DISTINCT n_nationkey AS x, n_nationkey AS y FROM nation",
    "anti": "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sum_group": "SELECT p, sum(q) AS q FROM (SELECT DISTINCT l_partkey AS p, l_quantity AS q FROM lineitem) GROUP BY p",
    "multi_agg": "SELECT l_partkey AS p, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1",
    "user_agg": "SELECT l_partkey AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1",
    "array_agg": "SELECT user_id AS u, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY 1",
    "having": "SELECT p FROM (SELECT DISTINCT l_partkey AS p, l_quantity AS q FROM lineitem) GROUP BY p HAVING sum(q) = 575",
    "global_agg": "SELECT x FROM (SELECT max(event_id) AS x FROM events) WHERE x IS NOT NULL",
    "global_agg_empty": "SELECT x FROM (SELECT max(event_id) AS x FROM events WHERE event_type = 'none') WHERE x IS NOT NULL",
    "union_rules": "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS x FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "closure": f"{_WITH}, {_REACH} SELECT x, y FROM reach",
    "clique": f"{_WITH}, {_REACH} SELECT a.x, a.y FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x",
    "turn_chain": "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS a FROM conversations), n AS (SELECT x.c, x.a, y.a AS b FROM t x JOIN t y ON x.c = y.c AND y.a = x.a + 1), r(c, a, b) AS (SELECT c, a, b FROM n UNION SELECT r.c, r.a, n.b FROM r JOIN n ON r.c = n.c AND r.b = n.a) SELECT c, a, b FROM r",
    "nonlinear": f"{_WITH}, {_REACH} SELECT x, y FROM reach",
    "mutual_recursion": f"{_WITH}, p(x, y, odd) AS (SELECT a, b, true FROM edge UNION SELECT p.x, e.b, NOT p.odd FROM p JOIN edge e ON p.y = e.a) SELECT x, y FROM p WHERE NOT odd",
    "staged": "SELECT max(n) AS b FROM (SELECT max(c_custkey) AS n FROM customer GROUP BY c_nationkey)",
    "callback_flat": "SELECT DISTINCT unnest(string_split(n_name, '')) AS l FROM nation",
    "callback_filter": "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey > 100",
    "circumscribe_final": "SELECT p FROM (SELECT DISTINCT l_partkey AS p, l_quantity AS q FROM lineitem) GROUP BY p HAVING sum(q) = 575",
    "self_support": "SELECT t.* FROM (VALUES (0, 'stock', 3), (1, 'stock', 3), (1, 'alarm', 4), (2, 'stock', 3)) t(step, pred, value), region WHERE r_regionkey = 0",
    "derivation": f"WITH RECURSIVE edge AS ({NATIONS_SQL}), {_REACH} SELECT 'one' AS rule, count(*) AS derivations, count(*) AS facts FROM edge UNION ALL SELECT 'more', count(*), count(DISTINCT (e.a, r.y)) FROM edge e JOIN reach r ON e.b = r.x",
    "incr_delta": "SELECT DISTINCT o_orderkey AS k, c_custkey AS c, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1",
}
