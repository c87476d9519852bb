"""Bodies of queries and rules as DataFrames.

Catalyst chooses join strategies, pushes filters down and prunes columns. What it cannot know is done here: constants and
repeated variables become filters on the scan, columns that nobody needs are dropped before the join and the rest
deduplicated unless a key is left, clauses that bind nothing new become semi-joins, and the order never multiplies where it could join.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.types import Types, constant
from stratalog.lang.ast import Const, Var
from stratalog.plans.ir import Body, Bound


class Lowering:
    def __init__(self, types: Types, constants: dict[str, Any]):
        self.types, self.constants = types, constants
        #: Fields by predicate that no two rows share and that are never null.
        self.keys: dict[str, frozenset[str]] = {}

    def value(self, c: Const, type_name: str):
        return self.types.literal(constant(c.text, self.constants), type_name)

    def clause(self, bound: Bound, rows: DataFrame, needed: set[str], carried: list[str] | None = None) -> DataFrame:
        """The needed variables of a clause. ``carried`` columns are kept; without them the result is distinct."""
        kinds = dict(bound.predicate.fields)
        first: dict[str, str] = {}
        for name, m in bound.columns:
            if isinstance(m, Const):
                value = self.value(m, kinds[name].type)
                rows = rows.filter(F.lit(False) if value is None else F.col(name).eqNullSafe(value))
            elif isinstance(m, Var):
                if m.name in first:
                    rows = rows.filter(F.col(first[m.name]).eqNullSafe(F.col(name)))
                else:
                    first[m.name] = name
        wanted = [v for v in first if v in needed]
        out = rows.select(*[F.col(first[v]).alias(v) for v in wanted], *(carried or []))
        if carried:
            return out
        if not wanted:
            return rows.select(F.lit(True).alias("_any")).limit(1)
        key = self.keys.get(bound.predicate.name)
        fixed = {n for n, m in bound.columns if isinstance(m, Const)} | {first[v] for v in wanted}
        return out if len(wanted) == len(kinds) or key and key <= fixed else out.distinct()

    def _never_null(self, bound: Bound) -> set[str]:
        """Variables of a clause that key fields bind."""
        key = self.keys.get(bound.predicate.name, frozenset())
        return {m.name for n, m in bound.columns if isinstance(m, Var) and n in key}

    def body(self, body: Body, source: Callable[[int, Bound], DataFrame], needed: list[str], carried: Callable[[int], list[str]] | None = None, first: int = 0) -> DataFrame:
        """Bindings of ``needed``; with ``carried`` also the columns that each clause carries, and not deduplicated.

        ``first`` is joined first: the clause that has the new rows.
        """
        uses: dict[str, int] = {}
        for c in body.clauses:
            for v in c.variables:
                uses[v] = uses.get(v, 0) + 1
        wanted = set(needed)
        parts = {}
        for k, c in enumerate(body.clauses):
            own = {v for v in c.variables if v in wanted or uses[v] > 1}
            extra = carried(k) if carried else []
            parts[k] = (self.clause(c, source(k, c), own, extra), [v for v in c.variables if v in own], extra)
        out, have, extra = parts.pop(first)
        have = list(have)
        solid = self._never_null(body.clauses[first])
        if not have and not extra:
            out = out.drop("_any") if parts else out
        started = bool(have) or bool(extra)
        pending_any = None if started else out
        kept = list(extra)
        while parts:
            k = min(parts, key=lambda j: (not set(parts[j][1]) & set(have), not parts[j][1], j))
            rows, variables, extra = parts.pop(k)
            solid |= self._never_null(body.clauses[k])
            shared = [v for v in variables if v in have]
            if not variables and not extra:
                # Only the existence of a row matters.
                if started:
                    out = out.join(rows, F.col("_any"), "left_semi")
                else:
                    pending_any = rows if pending_any is None else pending_any.join(rows.withColumnRenamed("_any", "_other"), F.col("_other"), "left_semi")
                continue
            if not started:
                out, have, kept, started = rows, list(variables), list(extra), True
                continue
            side = rows.select(*[F.col(v).alias(f"_r_{v}") for v in variables], *extra)
            on = None
            for v in shared:
                # Where one side is never null, null equals nothing there.
                term = F.col(v) == F.col(f"_r_{v}") if v in solid else F.col(v).eqNullSafe(F.col(f"_r_{v}"))
                on = term if on is None else on & term
            if not extra and set(variables) <= set(have):
                out = out.join(side, on, "left_semi")
                continue
            out = out.crossJoin(side) if on is None else out.join(side, on)
            fresh = [v for v in variables if v not in have]
            out = out.select(*[F.col(v) for v in have], *[F.col(f"_r_{v}").alias(v) for v in fresh], *kept, *extra)
            have += fresh
            kept += extra
        if pending_any is not None and started:
            out = out.join(pending_any.select(F.lit(True).alias("_any")), F.col("_any"), "left_semi")
        elif not started:
            out = pending_any
        if not needed and not kept:
            return out.select(F.lit(True).alias("holds")).limit(1)
        out = out.select(*needed, *kept)
        return out if carried else out.distinct()
