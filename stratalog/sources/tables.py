"""Tables as facts of predicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.types import Types, struct_type
from stratalog.lang.ast import Predicate


def as_facts(spark: SparkSession, pred: Predicate, data: Any, types: Types, mapping: dict[str, str | Column] | None = None, distinct: bool = True) -> DataFrame:
    """Distinct facts of a predicate from a DataFrame, or from tuples, dictionaries or single values.

    ``mapping`` gives a column or expression for each field; without it a DataFrame's columns are taken by name, or by place
    if the predicate is ordered and the names differ. Values are cast and range-checked; ``distinct=False`` is for rows
    that are known to be.
    """
    names = [n for n, _ in pred.fields]
    if not isinstance(data, DataFrame):
        rows = []
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, dict):
                rows.append(tuple(x[n] for n in names))
            elif isinstance(x, tuple):
                rows.append(tuple(x))
            else:
                rows.append((x,))
        data = spark.createDataFrame(rows, struct_type([(n, types.spark(f.type)) for n, f in pred.fields]))
    if mapping is None:
        by_name = set(names) <= set(data.columns)
        mapping = dict(zip(names, names if by_name else data.columns, strict=by_name or False)) if by_name or not pred.named else {}
    if set(mapping) != set(names):
        raise ValueError(f"{pred.name} needs a column for each of {names}")
    as_column = lambda m: F.col(m) if isinstance(m, str) else m
    rows = data.select(*[types.checked(as_column(mapping[n]), f.type).alias(n) for n, f in pred.fields])
    return rows.distinct() if distinct else rows
