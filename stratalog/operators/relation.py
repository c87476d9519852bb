"""The facts of a predicate and their aggregated view, with versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.aggregators import Builtin, Folded, folded
from stratalog.functions.types import Types, struct_type
from stratalog.lang.ast import Predicate
from stratalog.sources.shared import written

#: After so many additions the parts of a relation are written as one table.
PARTS = 12


def fact_id(columns: list[str]) -> Column:
    """A key of the content alone, stable over recomputation."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


class Relation:
    """Distinct facts, grown by sets of new ones. Rows have the fields' columns, and with ``tracked`` also _fid and _base."""

    def __init__(self, spark: SparkSession, pred: Predicate, types: Types, aggregators: dict[str, Builtin | Folded], tracked: bool, cited: bool = True):
        """``cited``: some rule rests on single facts of a group, so that the view has to list them."""
        self.spark, self.pred, self.tracked, self.cited = spark, pred, tracked, cited
        self.names = [n for n, _ in pred.fields]
        self.kinds = [(n, types.spark(f.type)) for n, f in pred.fields]
        self.folds = {n: (aggregators[f.agg], types.spark(f.type)) for n, f in pred.fields if f.agg}
        self.keys = [n for n in self.names if n not in self.folds]
        extra = [("_fid", "string"), ("_base", "boolean")] if tracked else []
        self.schema = struct_type([*self.kinds, *extra])
        self.facts = spark.createDataFrame([], self.schema)
        self.parts = 0
        self.version = 0
        self.log: list[tuple[int, DataFrame]] = []
        self._view: tuple[int, DataFrame] | None = None

    def with_ids(self, rows: DataFrame, base: bool) -> DataFrame:
        return rows.select(*self.names, fact_id(self.names).alias("_fid"), F.lit(base).alias("_base"))

    def new_of(self, rows: DataFrame) -> DataFrame:
        """Rows (fields only) that are no facts yet. Set difference compares null with null."""
        rows = rows.select(*self.names)
        return rows.subtract(self.facts.select(*self.names)) if self.parts else rows.distinct()

    def add(self, rows: DataFrame, base: bool) -> DataFrame | None:
        """Adds rows and returns the new facts, or None if there is none."""
        new = self.new_of(rows)
        new = written(self.with_ids(new, base) if self.tracked else new)
        if new.isEmpty():
            return None
        self.grow(new)
        return new

    def grow(self, new: DataFrame) -> None:
        self.facts = new if not self.parts else self.facts.union(new)
        self.parts += 1
        if self.parts > PARTS:
            self.facts, self.parts = written(self.facts), 1
        self.version += 1
        self.log.append((self.version, new))

    def replace(self, facts: DataFrame) -> None:
        """Takes written facts after a retraction; nothing is new by it, but groups may have changed."""
        self.facts, self.parts = facts, 1
        self.version += 1

    def view(self) -> DataFrame:
        """Current rows: the facts, or one row for each group with its folded columns.

        With tracking: _fids (supporting facts; without ``cited`` none of a group), _key (group) and _sig (exact set of the
        group's facts, by hashes that are merged, so that its size does not grow with the group).
        """
        if self._view and self._view[0] == self.version:
            return self._view[1]
        if self.tracked:
            key = fact_id(self.keys) if self.keys else F.lit("")
            if self.folds:
                h = F.xxhash64("_fid")
                fids = F.array_sort(F.collect_set("_fid")) if self.cited else F.first(F.array().cast("array<string>"))
                more = {"_fids": fids, "_sig": F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))}
                out = folded(self.facts, self.keys, self.folds, more).withColumn("_key", key)
            else:
                out = self.facts.select(*self.names, F.array("_fid").alias("_fids"), F.col("_fid").alias("_sig"), F.col("_fid").alias("_key"))
            out = out.select(*self.names, "_fids", "_sig", "_key")
        else:
            out = folded(self.facts, self.keys, self.folds).select(*self.names) if self.folds else self.facts
        if self.folds:
            out = written(out)
        self._view = (self.version, out)
        return out

    def delta(self, since: int, seen: DataFrame | None) -> DataFrame:
        """View rows that came after version ``since``; ``seen`` is the view at that version if columns are folded."""
        if since == 0:
            return self.view()
        if self.folds:
            return self.view().join(seen.select(*[F.col(n).alias(f"_s_{n}") for n in self.names]), _same(self.names), "left_anti") if seen is not None else self.view()
        new = [d for v, d in self.log if v > since]
        if not new:
            return self.view().limit(0)
        rows = new[0]
        for d in new[1:]:
            rows = rows.union(d)
        if not self.tracked:
            return rows
        live = self.view()
        return live.join(rows.select(F.col("_fid").alias("_new")).distinct(), F.col("_key") == F.col("_new"), "left_semi")


def _same(names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_s_{n}"))
    return on
