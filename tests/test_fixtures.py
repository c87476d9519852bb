"""The engine's semantics on small programs."""

import time

import pytest

from stratalog import Database, Expand, Filter, parse, parse_files
from stratalog.lang.errors import NoFixpoint

VU16 = {"Vu16": "array<int>"}
QUERIES = "Bar(u64)\nBaz{boom: i32, fizz: Vu16, bash: u64}\n?Ordered: Bar(~THREE)\n?Named: Baz{boom: ~SEVEN, fizz: out_var}\n?Join: Bar(idx) & Baz{fizz: join_out, bash: idx}\n"
BAZ = [(b, f, z) for z, b, f in ((2, 20, [3, 4]), (7, 20, [3, 4]), (7, 3, [3, 4]), (7, 42, [5, 46]))]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def baz(rows):
    """Fields are stored by name: bash, boom, fizz."""
    return [{"bash": b, "fizz": f, "boom": z} for b, f, z in rows]


def test_insert_gives_one_id_for_equal_facts(spark):
    db = Database(spark, "Bar(u64)\nBaz{boom: i32, fizz: Vu16}", types=VU16)
    ids = [db.insert("Bar", [x]).head()["fid"] for x in (3, 42, 3)]
    assert ids[0] == ids[2] != ids[1]
    ids = [db.insert_baz([{"boom": 3, "fizz": f}]).head()["fid"] for f in ([72, 34], [], [72, 34])]
    assert ids[0] == ids[2] != ids[1]
    assert db.size("Bar") == 2 and db.arity("Baz") == 2
    assert values(db.find("Bar", [42]).select("arg0")) == [(42,)] and db.find("Bar", [7]).isEmpty()
    assert values(db.get("Baz", ids[1]).select("boom")) == [(3,)]
    assert db.any_facts().count() == 4


def test_full_queries(spark):
    db = Database(spark, QUERIES, constants={"THREE": 3, "SEVEN": 7}, types=VU16)
    db.insert("Bar", [3, 42, 3])
    db.insert("Baz", baz(BAZ))
    assert db.query_ordered().count() == 1 and db.ask("Ordered")
    assert values(db.query("Named")) == [([3, 4],), ([5, 46],)]
    assert db.query("Join").columns == ["idx", "join_out"] and db.query("Join").count() == 2


def test_incremental_queries(spark):
    db = Database(spark, QUERIES, constants={"THREE": 3, "SEVEN": 7}, types=VU16)
    count = lambda q: (db.query(q).count(), db.query_incr(q).count())
    assert count("Ordered") == (0, 0)
    db.insert("Bar", [3])
    assert count("Ordered") == (1, 1)
    db.insert("Bar", [42, 3])
    assert count("Ordered") == (1, 0)
    db.insert("Baz", baz(BAZ[:1]))
    assert count("Named") == (0, 0)
    db.insert("Baz", baz(BAZ[1:2]))
    assert count("Named") == (1, 1)
    db.insert("Baz", baz(BAZ[2:3]))
    assert count("Named") == (1, 0)
    db.insert("Baz", baz(BAZ[3:]))
    assert count("Named") == (2, 1)
    assert count("Join") == (2, 2)
    assert db.query_incr_join().count() == 0


RULES = QUERIES.split("?")[0] + """Ordered(u64)
Named{out_var: Vu16}
JoinOut{join_out: Vu16, idx: u64}
?check_ordered: Ordered(x)
?check_named: Named {out_var: out_var}
?check_join: JoinOut {join_out: join_out, idx: idx}
?gen_check: Bar(~std::u64::MAX)
?gen_check_expr: Bar(~(3 + 7))
ordered_rule: Ordered(~FOUR) <- Bar(~THREE)
named_rule: Named{out_var: out_var} <- Baz{boom: ~SEVEN, fizz: out_var}
join_rule: JoinOut {join_out: join_out, idx: idx} <- Bar(idx) & Baz{fizz: join_out, bash: idx}
"""


@pytest.mark.parametrize("provenance", [False, True])
def test_rules(spark, provenance):
    def made():
        db = Database(spark, RULES, constants={"THREE": 3, "SEVEN": 7, "FOUR": 4}, types=VU16, provenance=provenance)
        db.insert("Bar", [3, 42, 3])
        db.insert("Baz", baz(BAZ))
        return db

    db = made()
    for rule in ("ordered_rule", "named_rule", "join_rule"):
        assert db.rule_invoke(rule).count() > 0
        assert getattr(db, f"rule_invoke_{rule}")().count() == 0
    other = made()
    other.run_rules()
    for d in (db, other):
        assert values(d.query("check_ordered")) == [(4,)]
        assert d.query("check_named").count() == 2 and d.query("check_join").count() == 2
        assert not d.ask("gen_check") and not d.ask("gen_check_expr")
    assert not other.run_rules_once() and not other.run_rules_default()


def test_callbacks(spark):
    text = "Foo(String)\nBar{a: u32, b: u64}\n?check_foo: Foo(out)\nxlat_foos: Foo(out) <- Bar{a: ~THREE, b: x} + xlat\nmore: Foo(out) <- Bar{a: ~THREE, b: x} + m::xlat\n"
    both = lambda r: [{"out": f"{r['x']}"}, {"out": f"{r['x']}.0"}]
    from pyspark.sql import functions as F

    expand = Expand(lambda v: F.array(F.struct(F.concat(v["x"].cast("string"), F.lit("!")).alias("out"))))
    db = Database(spark, text, constants={"THREE": 3}, callbacks={"xlat": both, "m::xlat": expand})
    db.insert("Bar", [(7, 4), (3, 42)])
    db.run_rules()
    assert values(db.query("check_foo")) == [("42",), ("42!",), ("42.0",)]


def test_callback_filter(spark):
    text = "P(i64)\nQ(i64)\nR(i64)\nf: Q(x) <- P(x) + big\ng: R(x) <- P(x) + py\n"
    db = Database(spark, text, callbacks={"big": Filter(lambda v: v["x"] > 2), "py": lambda r: [()] if r["x"] < 3 else []})
    db.insert("P", [1, 2, 3])
    db.run_rules()
    assert values(db.rows("Q")) == [(3,)] and values(db.rows("R")) == [(1,), (2,)]


AGG = {"u8_plus": sum, "vu16_append": lambda lists: sorted(x for v in lists for x in v)}


@pytest.mark.parametrize("fold", ["u8_plus", "sum"])
def test_aggregation(spark, fold):
    db = Database(spark, f"Foo(u8^{fold})\nBar(Vu16^vu16_append)\n?get_foo: Foo(out)\n?get_bar: Bar(out)\n", aggregators=AGG, types=VU16)
    assert values(db.query("get_foo")) == [] and values(db.query("get_bar")) == []
    db.insert("Foo", [3, 42, 3])
    db.insert("Bar", [([1, 3, 5],), ([2, 4, 8],)])
    assert values(db.query("get_foo")) == [(45,)] and values(db.query("get_bar")) == [([1, 2, 3, 4, 5, 8],)]


def test_keys_and_several_folds(spark):
    db = Database(spark, "T{k: i64, lo: i64^min, hi: i64^max, u: i64^plus}\n?q: T{k: k, lo: l, hi: h, u: u}\n?ten: T{k: k, u: ~(10)}", aggregators={"plus": sum})
    rows = [{"k": 1, "lo": 5, "hi": 5, "u": 5}, {"k": 1, "lo": 2, "hi": 9, "u": 5}, {"k": 2, "lo": 0, "hi": 0, "u": 1}]
    db.insert("T", rows + rows[:1])
    assert values(db.query("q")) == [(1, 2, 9, 10), (2, 0, 0, 1)] and values(db.query("ten")) == [(1,)]


CLOSED = "Foo(u8^plus)\nBar(u8)\n?get_bar: Bar(out)\nadvance_three: Bar(~(0)) <- ~Foo(~(3))\nadvance_ten: Bar(~(1)) <- ~Foo(~(10))\n"


@pytest.mark.parametrize("fold", [{"plus": sum}, None])
def test_circumscription(spark, fold):
    db = Database(spark, CLOSED if fold else CLOSED.replace("plus", "sum"), aggregators=fold)
    db.run_rules()
    assert values(db.query("get_bar")) == []
    db.insert("Foo", [3])
    db.run_rules()
    assert values(db.query("get_bar")) == [(0,)]
    db.insert("Foo", [7])
    db.run_rules()
    assert values(db.query("get_bar")) == [(1,)]


def test_self_support_and_repeated_insert(spark):
    text = "Foo(u8^sum)\nBar(u8^sum)\nBaz(u8^sum)\n?get_foo: Foo(out)\n?get_baz: Baz(out)\nohno: Foo(~(3)) <- ~Foo(~(0))\nretract_init: Baz(~(0)) <- ~Bar(~(0))\nbaz_add: Baz(~(4)) <- ~Baz(~(0))\n"
    db = Database(spark, text)
    db.insert("Foo", [0])
    db.run_rules()
    assert values(db.query("get_foo")) == [(3,)]
    db.insert("Bar", [0])
    db.run_rules()
    assert values(db.query("get_baz")) == [(4,)]
    db.insert("Bar", [0])
    db.run_rules()
    assert values(db.query("get_foo")) == [(3,)] and values(db.query("get_baz")) == []


CLIQUE = "reachable(u64,u64)\nedge(u64,u64)\nsame_clique(u64,u64)\n?clique: same_clique(~ZERO, ~END)\npromote: reachable(x, y) <- edge(x, y)\nextend: reachable(x, z) <- edge(x, y) & reachable(y, z)\nclique: same_clique(x, y) <- reachable(x, y) & reachable(y, x)\n"


def test_recursion(spark):
    db = Database(spark, CLIQUE, constants={"ZERO": 0, "END": 10})
    db.insert("edge", [(i, i + 1) for i in range(10)] + [(10, 0)])
    db.run_rules()
    assert [tuple(r) for r in db.query("clique").collect()] == [(True,)]
    assert db.size("reachable") == 121 and db.size("same_clique") == 121
    db.insert("edge", [(10, 11)])
    db.run_rules()
    assert db.size("reachable") == 132 and db.size("same_clique") == 121


def test_timeout_and_round_limit(spark):
    text = "Foo(u64)\ninc_foo: Foo(n_plus_one) <- Foo(n) + inc\n"
    inc = {"inc": lambda r: [{"n_plus_one": r["n"] + 1}]}
    db = Database(spark, text, callbacks=inc)
    db.insert("Foo", [3])
    begun = time.time()
    db.run_rules(timeout=1)
    assert time.time() - begun < 30 and db.size("Foo") >= 2
    db = Database(spark, text, callbacks=inc, max_rounds=2)
    db.insert("Foo", [3])
    with pytest.raises(NoFixpoint):
        db.run_rules()


@pytest.mark.parametrize(
    "text, facts, expected",
    [
        ("p(i64,i64,i64)\nq(i64,i64)\n?q: p(v0, v1, _) & q(v1, ~(7))", {"p": [(0, 2, 3), (3, 2, 5), (4, 4, 4)], "q": [(1, 3), (2, 7), (3, 4), (8, 2)]}, [(0, 2), (3, 2)]),
        ("p(i64,i64)\nq(i64,i64)\n?q: p(v0, v1) & q(v1, v2)", {"p": [(16, 16), (18, 18), (26, 26)], "q": [(16, 88), (18, 89)]}, [(16, 16, 88), (18, 18, 89)]),
        ("p(i64,i64)\nq(i64,i64)\n?q: p(v0, v1) & q(v1, v2)", {"p": [(16, 16), (16, 88)], "q": [(88, 15)]}, [(16, 88, 15)]),
        ("P(i64,i64)\n?q: P(x, x)", {"P": [(1, 2), (3, 3)]}, [(3,)]),
        ("P(i64)\nQ(i64)\n?q: P(x) & Q(_)", {"P": [1, 2]}, []),
        ("P(i64)\nQ(i64)\n?q: P(x) & Q(_)", {"P": [1, 2], "Q": [5, 6]}, [(1,), (2,)]),
        ("P(i64)\nQ(i64)\n?q: Q(_) & P(_)", {"P": [1, 2], "Q": [5, 6]}, [(True,)]),
        ("P(i64)\nQ(i64)\n?q: P(x) & Q(y)", {"P": [1, 2], "Q": [5]}, [(1, 5), (2, 5)]),
        ("e(i64,i64)\n?q: e(x, y) & e(y, z) & e(z, x)", {"e": [(1, 2), (2, 3), (3, 1), (3, 4)]}, [(1, 2, 3), (2, 3, 1), (3, 1, 2)]),
        ("P(i64)\n?q: ~P(x) & P(x)", {"P": [1]}, [(1,)]),
    ],
)
def test_joins(spark, text, facts, expected):
    db = Database(spark, text)
    for pred, rows in facts.items():
        db.insert(pred, rows)
    assert values(db.query("q")) == expected


def test_null_is_a_value(spark):
    db = Database(spark, "P(i64)\nQ(i64)\nR(i64)\nr: R(x) <- P(x) & Q(x)\n")
    db.insert("P", [(None,), (1,)])
    db.insert("Q", [(None,), (2,)])
    db.insert("P", [(None,)])
    db.run_rules()
    assert [tuple(r) for r in db.rows("R").collect()] == [(None,)] and db.size("P") == 2


def test_stages(spark):
    text = "In(i64)\nTot(i64^sum)\nOut(i64)\na@0: Tot(x) <- In(x)\nb@1: Out(x) <- Tot(x)\n"
    db = Database(spark, text)
    db.insert("In", [1, 2])
    assert db.ir.stages == [0, 1]
    assert db.run_rules_once() and db.rows("Out").isEmpty()
    assert db.run_rules_stage_1()
    db.run_rules()
    assert values(db.rows("Out")) == [(3,)]


def test_retraction_inside_a_surviving_group(spark):
    text = "Src(i64^sum)\nTot(i64^sum)\n?t: Tot(x)\nkeep: Tot(~(3)) <- Go(_)\ngone: Tot(~(7)) <- ~Src(~(1))\nGo(i64)\n"
    db = Database(spark, text)
    db.insert("Go", [1])
    db.insert("Src", [1])
    db.run_rules()
    assert values(db.query("t")) == [(10,)]
    db.insert("Src", [5])
    db.run_rules()
    assert values(db.query("t")) == [(3,)]


def test_second_derivation_keeps_a_fact(spark):
    text = "A(i64^sum)\nB(i64)\nC(i64)\none: C(~(1)) <- ~A(~(1))\ntwo: C(~(1)) <- B(_)\n"
    db = Database(spark, text)
    db.insert("A", [1])
    db.insert("B", [9])
    db.run_rules()
    db.insert("A", [2])
    db.run_rules()
    assert values(db.rows("C")) == [(1,)]


def test_facts_that_only_support_each_other_go(spark):
    text = "A(i64^sum)\nP(i64)\nQ(i64)\nin: P(~(1)) <- ~A(~(1))\npq: Q(x) <- P(x)\nqp: P(x) <- Q(x)\n"
    db = Database(spark, text)
    db.insert("A", [1])
    db.run_rules()
    assert db.size("P") == 1 and db.size("Q") == 1
    db.insert("A", [2])
    assert db.size("P") == 0 and db.size("Q") == 0


def test_derivations(spark):
    text = "E(i64,i64)\nP(i64,i64)\na: P(x, y) <- E(x, y)\nb: P(x, z) <- E(x, y) & P(y, z)\n"
    db = Database(spark, text, provenance=True)
    db.insert("E", [(1, 2), (2, 3), (3, 4), (1, 4)])
    db.run_rules()
    assert db.derivation("E", [(1, 2)]).depth() == 0
    d = db.derivation("P", [(2, 4)])
    assert d.rule == "b" and d.depth() == 2 and [p.rule for p in d.premises] == [None, "a"]
    assert str(d).splitlines()[0].endswith(" by b,") and str(d).splitlines()[1].startswith("  E")
    assert db.derivation("P", [(1, 4)]).rule == "a"
    assert db.derivation("P", [(4, 1)]) is None
    assert db.derivation("P", [(1, 3)], depth=1).premises[1].truncated
    assert db.provenance("P").count() == 7


def test_files(spark, tmp_path):
    (tmp_path / "a").write_text("P(i64)")
    (tmp_path / "b").write_text("?q: P(x) // the end")
    paths = [str(tmp_path / x) for x in "ab"]
    db = Database.from_files(spark, *paths)
    db.insert("P", [1])
    assert values(db.query("q")) == [(1,)]
    assert str(parse_files(*paths)) == str(parse("P(i64)\n?q: P(x)"))


def test_a_closure_keeps_its_timeout(spark):
    """It stops between doublings; a later run goes on to the end."""
    text = "edge(i64, i64)\npath(i64, i64)\na: path(x, y) <- edge(x, y)\nb: path(x, z) <- edge(x, y) & path(y, z)"
    db = Database(spark, text)
    n = 24
    db.bind("edge", spark.range(n).selectExpr("id AS arg0", "id + 1 AS arg1"), key=("arg0",))
    db.run_rules(timeout=0)
    assert db.size("path") < n * (n + 1) // 2
    db.run_rules()
    assert db.size("path") == n * (n + 1) // 2


def test_facts_by_id(spark):
    db = Database(spark, "P(i64)\nQ{a: i64, b: String}")
    (p,) = db.insert("P", [5]).collect()
    db.insert("Q", [{"a": 1, "b": None}])
    assert values(db.get("P", p["fid"])) == [(5, p["fid"])] and values(db.get("P", "none")) == []
    assert db.arity("P") == 1 and db.arity("Q") == 2
    assert sorted((r["predicate"], r["fact"]) for r in db.any_facts().collect()) == [("P", '{"arg0":5}'), ("Q", '{"a":1}')]
    assert p["fid"] in {r["fid"] for r in db.any_facts().collect()}


def test_keys_of_bound_tables(spark):
    """A key's rows are used as they are; facts that come later are deduplicated again."""
    n = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k long, s string")
    db = Database(spark, "N{k: i64, s: String}\nM{k: i64, s: String}\n?q: N{k: k, s: s} & M{k: k, s: s}\n?s: N{s: s}\n?self: N{k: a, s: s} & N{k: b, s: s}")
    db.bind("N", n, key=("k",))
    db.bind("M", n.union(n).union(spark.createDataFrame([(None, None)], "k long, s string")))
    assert values(db.query("q").na.fill("-")) == [(1, "a"), (2, "-"), (3, "b")]
    assert values(db.query("self").select("a", "b")) == [(1, 1), (2, 2), (3, 3)]
    db.insert("N", [{"k": 1, "s": "b"}, {"k": None, "s": "a"}])
    assert values(db.query("s").na.fill("-")) == [("-",), ("a",), ("b",)]
    assert values(db.query("self").filter("a <> b").select("a", "b")) == [(1, 3), (3, 1)]


def test_bind_and_ranges(spark):
    db = Database(spark, "N{key: i32, name: String}\n?q: N{key: k, name: ~(\"b\")}")
    db.bind("N", spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string"), {"key": "x", "name": "y"})
    assert values(db.query("q")) == [(2,)] and db.size("N") == 2
    with pytest.raises(Exception, match="out of range"):
        Database(spark, "P(u8)").insert("P", [300])


def test_stream(spark, tmp_path):
    from stratalog.streaming.micro_batch import feed

    db = Database(spark, CLIQUE, constants={"ZERO": 0, "END": 2})
    spark.createDataFrame([(0, 1), (1, 2)], "a long, b long").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = feed(db, "edge", stream, str(tmp_path / "ck"), {"arg0": "a", "arg1": "b"}, then=lambda d, n: seen.append(d.size("reachable")))
    q.processAllAvailable()
    spark.createDataFrame([(2, 0)], "a long, b long").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == 9 and db.ask("clique")
    again = Database(spark, CLIQUE, constants={"ZERO": 0, "END": 2})
    q = feed(again, "edge", stream, str(tmp_path / "ck"), {"arg0": "a", "arg1": "b"})
    q.processAllAvailable()
    assert again.size("edge") == 3 and again.size("reachable") == 9
    spark.createDataFrame([(0, 3)], "a long, b long").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert again.size("edge") == 4 and again.size("reachable") == 12


def test_closed_groups_keep_no_list_of_facts(spark):
    text = "In{k: i64, x: i64^sum}\nLoud{k: i64}\n?q: Loud{k: k}\nloud: Loud{k: k} <- ~In{k: k, x: ~(3)}\n"
    db = Database(spark, text)
    db.insert("In", [{"k": 1, "x": 1}, {"k": 1, "x": 2}, {"k": 2, "x": 3}])
    db.run_rules()
    assert values(db.query("q")) == [(1,), (2,)]
    assert all(r["_fids"] == [] for r in db.relation("In").view().collect())
    db.insert("In", [{"k": 1, "x": 5}])
    db.run_rules()
    assert values(db.query("q")) == [(2,)]
    proof = db.derivation("Loud", {"k": 2})
    assert proof.rule == "loud" and len(proof.premises) == 1


def test_incremental_query_over_many_calls(spark):
    db = Database(spark, "P(i64)\nQ(i64)\n?q: P(x) & Q(_)\n")
    db.insert("Q", [1])
    for k in range(15):
        db.insert("P", [k, k + 1])
        assert values(db.query_incr("q")) == ([(0,), (1,)] if k == 0 else [(k + 1,)])
    db.insert("Q", [2])
    assert values(db.query_incr("q")) == []
