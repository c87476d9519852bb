"""A database: the facts of a program's predicates, its queries, and its rules run to a fixpoint."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import aggregators as A
from stratalog.functions.callbacks import applied
from stratalog.functions.types import Types
from stratalog.lang import parser
from stratalog.lang.ast import Const, Program, Var
from stratalog.lang.errors import NoFixpoint, ProgramError, UnknownName
from stratalog.operators.derivation import Derivation
from stratalog.operators.relation import PARTS, Relation, fact_id
from stratalog.operators.supports import PREMISE, Supports, _group_key
from stratalog.plans.ir import Body, Bound, RuleIr, analyse
from stratalog.plans.lower import Lowering
from stratalog.sources.shared import written
from stratalog.sources.tables import as_facts


class Database:
    """Facts, queries and rules of one program.

    ``constants`` maps names used after ``~`` to values, ``callbacks`` names after ``+`` to Filter, Expand or Python functions,
    ``aggregators`` names after ``^`` to Python functions on lists (or Builtin), ``types`` further type names to Spark types.
    Supports of facts are tracked only if a rule closes over a group (``~P``) or ``provenance`` is asked for.
    ``reinsert="invalidate"``: inserting a fact again breaks conclusions on its group; "ignore" leaves them.
    """

    def __init__(self, spark: SparkSession, program: str | Program, constants: dict[str, Any] | None = None, callbacks: dict[str, Any] | None = None, aggregators: dict[str, Any] | None = None, types: dict[str, str] | None = None, provenance: bool = False, reinsert: str = "invalidate", max_rounds: int = 10_000):
        self.spark = spark
        self.program = parser.parse(program) if isinstance(program, str) else program
        self.ir = analyse(self.program)
        self.types = Types(types)
        self.constants, self.callbacks = dict(constants or {}), dict(callbacks or {})
        self.lowering = Lowering(self.types, self.constants)
        self.max_rounds, self.reinsert = max_rounds, reinsert
        folds = {**A.BUILTIN, **{n: f if isinstance(f, (A.Builtin, A.Folded)) else A.Folded(f) for n, f in (aggregators or {}).items()}}
        self._check_names(folds)
        closed = {c.predicate.name for r in self.ir.rules.values() for c in r.body.clauses if c.circumscribed}
        self.tracked = bool(closed) or provenance
        cited = {c.predicate.name for r in self.ir.rules.values() for c in r.body.clauses if not c.circumscribed}
        self.relations = {n: Relation(spark, p, self.types, folds, self.tracked, n in cited) for n, p in self.ir.predicates.items()}
        self.supports = Supports(spark, self.relations, closed) if self.tracked else None
        #: For each rule and clause: the version of the predicate that it has seen, and that view if its columns are folded.
        self._seen: dict[tuple[str, int], tuple[int, DataFrame | None]] = {}
        #: What each incremental query has returned, in parts.
        self._told: dict[str, list[DataFrame]] = {}

    @classmethod
    def from_files(cls, spark: SparkSession, *paths: str, **options: Any) -> Database:
        return cls(spark, parser.parse_files(*paths), **options)

    def _check_names(self, folds: dict[str, Any]) -> None:
        for p in self.ir.predicates.values():
            for _, f in p.fields:
                self.types.spark(f.type)
                if f.agg and f.agg not in folds:
                    raise UnknownName(f"aggregator {f.agg} is not registered")
        for r in self.ir.rules.values():
            if r.callback and r.callback.removeprefix("crate::") not in self.callbacks and r.callback not in self.callbacks:
                raise UnknownName(f"callback {r.callback} is not registered")
        bodies = [*self.ir.queries.values(), *(r.body for r in self.ir.rules.values())]
        for c in [c for b in bodies for c in b.clauses] + [r.head for r in self.ir.rules.values()]:
            for name, m in c.columns:
                if isinstance(m, Const):
                    self.lowering.value(m, dict(c.predicate.fields)[name].type)

    # Facts

    def relation(self, pred: str) -> Relation:
        return self.relations[pred] if pred in self.relations else next(r for n, r in self.relations.items() if n.lower() == pred.lower())

    def insert(self, pred: str, data: Any, mapping: dict[str, str | Column] | None = None) -> DataFrame:
        """Adds base facts (equal ones once) and returns them with their ids in column ``fid``."""
        r = self.relation(pred)
        self.lowering.keys.pop(r.pred.name, None)
        rows = written(as_facts(self.spark, r.pred, data, self.types, mapping))
        new = r.add(rows, True)
        if self.tracked:
            ids = r.with_ids(rows, True).select("_fid")
            r_facts = r.facts.join(ids.withColumn("_again", F.lit(True)), "_fid", "left").withColumn("_base", F.col("_base") | F.coalesce("_again", F.lit(False)))
            derived_too = r.facts.filter("NOT _base").join(ids, "_fid", "left_semi")
            if not derived_too.isEmpty():
                r.replace(written(r_facts.select(*r.facts.columns)))
            # Only a change of a group that some rule closed over can take the ground from a conclusion.
            if r.pred.name in self.supports.closed:
                touched = r.with_ids(rows, True).select(F.lit(r.pred.name).alias("g_pred"), _group_key(r).alias("g_key")).distinct()
                lost = self.reinsert == "invalidate" and self.supports.drop_touched(touched)
                if lost or new is not None:
                    self.supports.settle(lost)
        return rows.select(*r.names, fact_id(r.names).alias("fid"))

    def bind(self, pred: str, table: DataFrame, mapping: dict[str, str | Column] | None = None, key: tuple[str, ...] = ()) -> None:
        """Adds the rows of a table as base facts. The first table of a predicate is used in place, not copied.

        ``key`` names fields that no two rows share and that are never null. The caller answers for it: such rows are not
        deduplicated before joins, and joins on these fields are by plain equality.
        """
        r = self.relation(pred)
        if r.version or self.tracked:
            self.lowering.keys.pop(r.pred.name, None)
            self.insert(pred, table, mapping)
        else:
            if key:
                self.lowering.keys[r.pred.name] = frozenset(key)
            r.grow(as_facts(self.spark, r.pred, table, self.types, mapping, distinct=not key))

    def facts(self, pred: str) -> DataFrame:
        """Raw facts of a predicate, before folding."""
        r = self.relation(pred)
        return r.facts.select(*r.names)

    def rows(self, pred: str) -> DataFrame:
        """Current rows of a predicate: folded if it has folded columns."""
        r = self.relation(pred)
        return r.view().select(*r.names)

    def find(self, pred: str, fact: Any) -> DataFrame:
        """The facts equal to the given ones, with their ids; null equals null."""
        r = self.relation(pred)
        wanted = as_facts(self.spark, r.pred, fact, self.types)
        return r.facts.select(*r.names).intersect(wanted).select("*", fact_id(r.names).alias("fid"))

    def get(self, pred: str, fid: str) -> DataFrame:
        r = self.relation(pred)
        return r.facts.select(*r.names, fact_id(r.names).alias("fid")).filter(F.col("fid") == fid)

    def size(self, pred: str) -> int:
        return self.relation(pred).facts.count()

    def arity(self, pred: str) -> int:
        return len(self.relation(pred).names)

    def any_facts(self) -> DataFrame:
        """All facts as (predicate, fid, fact): the fact as JSON."""
        out = None
        for n, r in self.relations.items():
            one = r.facts.select(F.lit(n).alias("predicate"), fact_id(r.names).alias("fid"), F.to_json(F.struct(*r.names)).alias("fact"))
            out = one if out is None else out.union(one)
        return out

    # Queries

    def _body(self, name: str) -> tuple[str, Body]:
        found = name if name in self.ir.queries else next((q for q in self.ir.queries if q.lower() == name.lower()), None)
        if found is None:
            raise ProgramError(f"query {name} is not defined")
        return found, self.ir.queries[found]

    def query(self, name: str) -> DataFrame:
        """Distinct bindings of a query's variables, in order of appearance; a query without variables has column ``holds``."""
        _, body = self._body(name)
        return self.lowering.body(body, lambda k, c: self._view(c), list(body.types))

    def ask(self, name: str) -> bool:
        """Whether a query has a result."""
        return not self.query(name).isEmpty()

    def query_incr(self, name: str) -> DataFrame:
        """Bindings that this call has not returned before. Retracted bindings are not reported."""
        name, body = self._body(name)
        rows = self._new_bindings(f"?{name}", body)
        if rows is None:
            return self.query(name).limit(0)
        told = self._told.setdefault(name, [])
        if len(told) > PARTS:
            told[:] = [written(reduce(DataFrame.union, told))]
        new = written(rows.subtract(reduce(DataFrame.union, told)) if told else rows)
        told.append(new)
        return new

    def _view(self, c: Bound) -> DataFrame:
        r = self.relations[c.predicate.name]
        return r.view().select(*r.names)

    def _new_bindings(self, owner: str, body: Body, source: Callable[[int, Bound, DataFrame], DataFrame] | None = None, carried: Callable[[int], list[str]] | None = None) -> DataFrame | None:
        """Bindings with at least one row that ``owner`` has not seen, or None if nothing is new. Marks all as seen.

        For each clause its new rows are joined with all rows of the others.
        """
        put = source or (lambda k, c, rows: rows.select(*self.relations[c.predicate.name].names))
        relations = [self.relations[c.predicate.name] for c in body.clauses]
        before = [self._seen.get((owner, k), (0, None)) for k in range(len(relations))]
        changed = [k for k, r in enumerate(relations) if r.version > before[k][0]]
        # Where a predicate is still empty there is no binding, and nothing is marked.
        if not changed or not all(r.version for r in relations):
            return None
        states = {(owner, k): (r.version, r.view() if r.folds else None) for k, r in enumerate(relations)}
        needed, out = list(body.types), None
        # If no clause has seen anything, the first one's new rows are all its rows, and one join gives everything.
        for at in changed if any(v for v, _ in before) else changed[:1]:
            new = relations[at].delta(*before[at])
            one = self.lowering.body(body, lambda k, c, at=at, new=new: put(k, c, new if k == at else relations[k].view()), needed, carried, at)
            out = one if out is None else out.union(one)
        self._seen.update(states)
        return out if carried else out.distinct()

    # Rules

    def rule_invoke(self, name: str) -> DataFrame:
        """Fires one rule on what it has not seen and returns the new facts only."""
        r = self.relations[self.ir.rules[name].head.predicate.name]
        new = self._fire(self.ir.rules[name])
        return new.select(*r.names) if new is not None else r.facts.select(*r.names).limit(0)

    def _fire(self, rule: RuleIr) -> DataFrame | None:
        head = self.relations[rule.head.predicate.name]
        if not self.tracked:
            self.lowering.keys.pop(head.pred.name, None)
            rows = self._new_bindings(rule.name, rule.body)
            return None if rows is None else head.add(self._head(rule, rows, []), False)
        clauses = range(len(rule.body.clauses))

        def source(k: int, c: Bound, rows: DataFrame) -> DataFrame:
            kind = "group" if c.circumscribed else "facts"
            p = F.struct(F.lit(kind).alias("kind"), F.lit(c.predicate.name).alias("pred"), (F.array().cast("array<string>") if c.circumscribed else F.col("_fids")).alias("fids"), (F.col("_key") if c.circumscribed else F.lit(None).cast("string")).alias("key"), (F.col("_sig") if c.circumscribed else F.lit(None).cast("string")).alias("sig"))
            return rows.select(*self.relations[c.predicate.name].names, p.cast(PREMISE).alias(f"_p{k}"))

        rows = self._new_bindings(rule.name, rule.body, source, lambda k: [f"_p{k}"])
        if rows is None:
            return None
        premises = [f"_p{k}" for k in clauses]
        made = self._head(rule, rows, premises).select(*head.names, F.array(*premises).alias("premises"))
        made = written(made.select(*head.names, fact_id(head.names).alias("fid"), "premises").distinct())
        new = head.add(made, False)
        if made.isEmpty():
            return None
        self.supports.add(made.select(F.lit(head.pred.name).alias("pred"), "fid", F.lit(rule.name).alias("rule"), "premises"), head)
        if new is not None and head.pred.name in self.supports.closed:
            self.supports.settle()
        return new

    def _head(self, rule: RuleIr, rows: DataFrame, carried: list[str]) -> DataFrame:
        kinds = dict(rule.head.predicate.fields)
        if rule.callback:
            call = self.callbacks.get(rule.callback, self.callbacks.get(rule.callback.removeprefix("crate::")))
            fresh = [(n, self.types.spark(t)) for n, t in sorted(rule.fresh.items())]
            rows = applied(rows, call, list(rule.body.types), fresh, carried)
        columns = []
        for name, m in rule.head.columns:
            kind = kinds[name].type
            value = F.col(m.name) if isinstance(m, Var) else self.lowering.value(m, kind)
            if value is None:
                raise ProgramError(f"constant {m} in the head of {rule.name} is out of range of {kind}")
            columns.append(self.types.checked(value, kind).alias(name))
        return rows.select(*columns, *carried)

    def run_stage(self, stage: int | None, deadline: float | None = None) -> bool:
        """Fires the rules of a stage once, in order of name; tells whether one made a new fact."""
        productive = False
        for rule in self.ir.of_stage(stage):
            if deadline is not None and time.monotonic() >= deadline:
                return productive
            productive |= self._fire(rule) is not None
        return productive

    def run_rules_once(self, deadline: float | None = None) -> bool:
        """One round: stages in order until one is productive."""
        return any(self.run_stage(s, deadline) for s in self.ir.stages)

    def run_rules(self, timeout: float | None = None) -> None:
        """Rounds until no stage is productive, or until ``timeout`` seconds have passed."""
        deadline = None if timeout is None else time.monotonic() + timeout
        self._close(deadline)
        for _ in range(self.max_rounds):
            if deadline is not None and time.monotonic() >= deadline:
                return
            if not self.run_rules_once(deadline):
                return
        raise NoFixpoint(f"still productive after {self.max_rounds} rounds")

    def _closures(self) -> list[tuple[RuleIr, RuleIr, str]]:
        """Pairs of rules P(x, y) <- E(x, y) and P(x, z) <- E or P (x, y) & E or P (y, z) that alone define P."""
        out = []
        for base in self.ir.rules.values():
            head = base.head
            p = head.predicate.name
            own = [r for r in self.ir.rules.values() if r.head.predicate.name == p]
            if len(own) != 2 or len(base.body.clauses) != 1 or any(r.callback or r.stage is not None for r in own) or self.relations[p].folds:
                continue
            (step,) = (r for r in own if r is not base)
            (e,) = base.body.clauses
            everything = [head, e, step.head, *step.body.clauses]
            if len(step.body.clauses) != 2 or any(len(c.columns) != 2 or len(c.predicate.fields) != 2 or any(not isinstance(m, Var) for _, m in c.columns) for c in everything):
                continue
            by_place = lambda c: [dict(c.columns)[n].name for n, _ in c.predicate.fields]
            a, b = step.body.clauses
            x, y, z = *by_place(a), by_place(b)[1]
            if by_place(head) != by_place(e) or len(set(by_place(e))) != 2 or by_place(b)[0] != y or by_place(step.head) != [x, z] or len({x, y, z}) != 3:
                continue
            names = {a.predicate.name, b.predicate.name}
            if p in names and names <= {p, e.predicate.name} and e.predicate.name != p and not self.relations[e.predicate.name].folds:
                out.append((base, step, e.predicate.name))
        return out

    def _close(self, deadline: float | None = None) -> None:
        """Transitive closures from scratch by doubling: as many rounds as the logarithm of the longest path.

        Past the deadline it stops between rounds; the rules have then seen nothing, and a later run goes on from these facts.
        """
        if self.tracked:
            return
        for base, step, edge in self._closures():
            p, e = self.relations[base.head.predicate.name], self.relations[edge]
            if p.version or not e.version or any(k[0] in (base.name, step.name) for k in self._seen):
                continue
            first = e.view().select(*[F.col(n).alias(m) for n, m in zip(e.names, p.names, strict=True)])
            new = p.add(first, False)
            x, y = p.names
            while new is not None:
                if deadline is not None and time.monotonic() >= deadline:
                    return
                # Every path that is new by now has a new part: new with all, and all with new.
                every = p.facts
                right = lambda d: d.select(F.col(x).alias("_m"), F.col(y).alias("_z"))
                pairs = new.join(right(every), F.col(y).eqNullSafe(F.col("_m"))).select(x, F.col("_z").alias(y))
                back = every.join(right(new), F.col(y).eqNullSafe(F.col("_m"))).select(x, F.col("_z").alias(y))
                new = p.add(pairs.union(back).distinct(), False)
            for rule in (base, step):
                for k, c in enumerate(rule.body.clauses):
                    self._seen[(rule.name, k)] = (self.relations[c.predicate.name].version, None)

    # Provenance

    def provenance(self, pred: str) -> DataFrame:
        """All derivations of a predicate's facts: fid, rule, premises; base facts have no rule."""
        if not self.tracked:
            raise ProgramError("the database was made without provenance")
        r = self.relation(pred)
        base = r.facts.filter("_base").select(F.col("_fid").alias("fid"), F.lit(None).cast("string").alias("rule"), F.array().cast(f"array<{PREMISE}>").alias("premises"))
        return base.union(self.supports.rows.filter(F.col("pred") == r.pred.name).select("fid", "rule", "premises"))

    def derivation(self, pred: str, fact: Any, depth: int = 2) -> Derivation | None:
        """A proof of least depth of one fact, cut at ``depth`` rules; None for what is no fact."""
        if not self.tracked:
            raise ProgramError("the database was made without provenance")
        r = self.relation(pred)
        found = self.find(pred, fact).select("fid").head(1)
        if not found:
            return None
        level, supports, shown, base = {(r.pred.name, found[0]["fid"])}, {}, {}, set()
        for k in range(depth + 1):
            rows = []
            for name in {p for p, _ in level}:
                fids = [f for p, f in level if p == name]
                rel = self.relations[name]
                for row in rel.facts.filter(F.col("_fid").isin(fids)).select("_fid", "_base", F.to_json(F.struct(*rel.names)).alias("fact")).collect():
                    shown[(name, row["_fid"])] = f"{name}{row['fact']}"
                    if row["_base"]:
                        base.add((name, row["_fid"]))
                if k < depth:
                    rows += self.supports.rows.filter((F.col("pred") == name) & F.col("fid").isin(fids)).collect()
            following = set()
            for s in rows:
                cited = []
                for p in s["premises"]:
                    fids = p["fids"] if p["kind"] == "facts" else [f["_fid"] for f in self.relations[p["pred"]].facts.filter(_group_key(self.relations[p["pred"]]) == p["key"]).select("_fid").collect()]
                    cited += [(p["pred"], f) for f in fids]
                supports.setdefault((s["pred"], s["fid"]), []).append((s["rule"], cited))
                following |= set(cited)
            level = {f for f in following if f not in supports}
            if not level:
                break

        def prove(node: tuple[str, str], left: int, above: frozenset) -> Derivation | None:
            text = shown.get(node, node[0])
            if node in base:
                return Derivation(text)
            if left == 0:
                return Derivation(text, truncated=True)
            best = None
            for rule, cited in sorted(supports.get(node, []), key=lambda s: s[0]):
                if any(c in above or c == node for c in cited):
                    continue
                parts = [prove(c, left - 1, above | {node}) for c in cited]
                if all(p is not None for p in parts):
                    one = Derivation(text, rule, tuple(parts))
                    if best is None or one.depth() < best.depth():
                        best = one
            return best

        return prove((r.pred.name, found[0]["fid"]), depth, frozenset())

    # Names made of predicates, queries, rules and stages

    def __getattr__(self, name: str) -> Callable:
        ir = self.__dict__.get("ir")
        if ir is not None:
            for prefix, names, call in (("insert_", ir.predicates, self.insert), ("query_incr_", ir.queries, self.query_incr), ("query_", ir.queries, self.query), ("rule_invoke_", ir.rules, self.rule_invoke)):
                if name.startswith(prefix):
                    rest = name.removeprefix(prefix)
                    for n in names:
                        if n == rest or (n.lower() == rest and prefix != "rule_invoke_"):
                            return lambda *a, **k: call(n, *a, **k)
            if name == "run_rules_default":
                return lambda: self.run_stage(None)
            if name.startswith("run_rules_stage_") and name.removeprefix("run_rules_stage_").isdigit():
                return lambda: self.run_stage(int(name.removeprefix("run_rules_stage_")))
        raise AttributeError(name)
