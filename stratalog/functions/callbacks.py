"""Functions that rules call for each binding: expressions that Spark runs itself, or Python functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stratalog.functions.types import struct_type


@dataclass(frozen=True)
class Filter:
    """Keeps the bindings for which an expression over their columns holds."""

    make: Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Expand:
    """An expression that gives an array of structs; each struct holds the new variables of one row."""

    make: Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Rows:
    """A pure Python function from a binding (a dictionary) to rows: dictionaries of the new variables, or tuples of them by name."""

    call: Callable[[dict[str, Any]], Iterable]


def applied(rows: DataFrame, callback: Filter | Expand | Rows | Callable, variables: list[str], fresh: list[tuple[str, str]], carried: list[str]) -> DataFrame:
    """Bindings with the callback's new variables; ``carried`` columns go along unseen."""
    if isinstance(callback, Filter):
        return rows.filter(callback.make({v: F.col(v) for v in variables}))
    names = sorted(n for n, _ in fresh)
    if isinstance(callback, Expand):
        out = rows.select("*", F.explode(callback.make({v: F.col(v) for v in variables})).alias("_made"))
        return out.select(*rows.columns, *[F.col(f"_made.{n}").alias(n) for n in names])
    call = callback.call if isinstance(callback, Rows) else callback
    kept = [*variables, *carried]
    schema = struct_type([*[(f.name, f.dataType.simpleString()) for f in rows.select(*kept).schema], *fresh])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, made = [], {n: [] for n, _ in fresh}
            for k, row in enumerate(batch.select(variables).to_pylist()) if variables else enumerate([{}] * batch.num_rows):
                for new in call(row):
                    values = new if isinstance(new, dict) else dict(zip(names, new if isinstance(new, tuple) else (new,), strict=True))
                    places.append(k)
                    for n, _ in fresh:
                        made[n].append(values[n])
            old = batch.select(kept).take(pa.array(places, pa.int64()))
            columns = [*old.columns, *[pa.array(made[n], arrow.field(n).type) for n, _ in fresh]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select(*kept).mapInArrow(run, schema)
