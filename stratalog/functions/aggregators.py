"""Functions that fold a column over a group. All are associative and commutative on sets of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a user function folds at once in the first of its two levels are dealt to so many parts of a group.
PARTS = 16


@dataclass(frozen=True)
class Builtin:
    """An aggregate expression; Spark folds it partially before rows move."""

    make: Callable[[Column], Column]


@dataclass(frozen=True)
class Folded:
    """A Python function from a list of values to one value."""

    fold: Callable[[list], Any]


BUILTIN: dict[str, Builtin] = {
    "sum": Builtin(F.sum), "min": Builtin(F.min), "max": Builtin(F.max), "or": Builtin(F.bool_or), "and": Builtin(F.bool_and),
    "bit_or": Builtin(F.bit_or), "bit_and": Builtin(F.bit_and), "bit_xor": Builtin(F.bit_xor),
    "sorted_concat": Builtin(lambda c: F.array_sort(F.flatten(F.collect_list(c)))),
    "set_union": Builtin(lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))),
}


def folded(rows: DataFrame, keys: list[str], columns: dict[str, tuple[Builtin | Folded, str]], more: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` grouped by ``keys``; each column folded by its function and cast to its type.

    ``more`` are further aggregates by name. Without rows there is no group, even without keys. User functions fold parts of a group first, then the parts' values.
    """
    user = {c: f for c, (f, _) in columns.items() if isinstance(f, Folded)}
    group = [F.col(k) for k in keys] or [F.lit(1).alias("_all")]
    plain = [f.make(F.col(c)).cast(t).alias(c) for c, (f, t) in columns.items() if isinstance(f, Builtin)] + [m.alias(n) for n, m in (more or {}).items()]
    if not user:
        out = rows.groupBy(*group).agg(*plain)
        return out.drop("_all") if not keys else out
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    folds = {c: F.udf(f.fold, columns[c][1], useArrow=True) for c, f in user.items()}
    part = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in user]), F.lit(PARTS)).alias("_part")
    lists = lambda d, *by: d.groupBy(*by).agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in user])
    done = lambda d, by: d.select(*by, *[folds[c](F.col(c)).alias(c) for c in user])
    first = done(lists(rows.select("*", part), *keys, "_part"), [*keys, "_part"])
    out = done(lists(first, *keys), keys)
    if plain:
        rest = rows.groupBy(*keys).agg(*plain).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in columns if c not in user], *(more or {}))
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        out = out.join(rest, on).drop(*[f"_k_{k}" for k in keys])
    return out.drop("_all")
