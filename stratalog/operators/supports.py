"""Supports of derived facts: what each derivation rests on, and the retraction of what has lost its ground.

A support is a row (pred, fid, rule, premises, restamped); a premise cites single facts, or a closed group by its exact set
of facts. A support falls when a cited fact is gone or a cited group has changed; a derived fact without support falls
with it, and so on. At last, facts that only support each other are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.relation import Relation
from stratalog.sources.shared import written

PREMISE = "struct<kind:string,pred:string,fids:array<string>,key:string,sig:string>"
SCHEMA = f"pred string, fid string, rule string, premises array<{PREMISE}>"


class Supports:
    def __init__(self, spark: SparkSession, relations: dict[str, Relation], closed: set[str]):
        """``closed`` are the predicates whose groups some rule closes over."""
        self.spark, self.relations, self.closed = spark, relations, closed
        self.rows = spark.createDataFrame([], SCHEMA)

    def add(self, new: DataFrame, head: Relation) -> None:
        """Takes written supports of facts just added to ``head``. A premise on the very group that the head joined is stamped anew."""
        if head.pred.name in self.closed:
            groups = head.view().select(F.col("_key").alias("_now_key"), F.col("_sig").alias("_now_sig"))
            key = head.facts.select(F.col("_fid").alias("fid"), _group_key(head).alias("_own"))
            own = new.join(key, "fid").join(groups, F.col("_own") == F.col("_now_key"))
            stamp = lambda p: F.when((p["kind"] == "group") & (p["pred"] == head.pred.name) & (p["key"] == F.col("_own")), F.struct(p["kind"].alias("kind"), p["pred"].alias("pred"), p["fids"].alias("fids"), p["key"].alias("key"), F.col("_now_sig").alias("sig"))).otherwise(p)
            new = own.select("pred", "fid", "rule", F.transform("premises", stamp).cast(f"array<{PREMISE}>").alias("premises"))
        self.rows = written(self.rows.union(new).distinct())

    def groups(self) -> DataFrame | None:
        out = None
        for name in sorted(self.closed):
            one = self.relations[name].view().select(F.lit(name).alias("g_pred"), F.col("_key").alias("g_key"), F.col("_sig").alias("g_sig"))
            out = one if out is None else out.union(one)
        return out

    def live(self) -> DataFrame:
        out = None
        for name, r in self.relations.items():
            one = r.facts.select(F.lit(name).alias("f_pred"), F.col("_fid").alias("f_fid"), F.col("_base").alias("f_base"))
            out = one if out is None else out.union(one)
        return out

    def drop_touched(self, touched: DataFrame) -> bool:
        """Drops supports on groups (g_pred, g_key) that an insertion touched, changed or not."""
        on = F.col("p.kind") == "group"
        cited = self.rows.select("*", F.explode("premises").alias("p")).filter(on)
        bad = written(cited.join(touched, (F.col("p.pred") == F.col("g_pred")) & (F.col("p.key") == F.col("g_key")), "left_semi").select("pred", "fid", "rule", "premises"))
        if bad.isEmpty():
            return False
        self.rows = written(self.rows.subtract(bad))
        return True

    def settle(self, lost: bool = False, most: int = 1000) -> None:
        """Retracts until every fact stands; ``lost`` tells that supports were dropped before."""
        for _ in range(most):
            fell, removed = self._step()
            lost |= fell
            if not removed and (not lost or not self._unfounded()):
                return
        raise RuntimeError("retraction did not end")

    def _bad(self) -> DataFrame:
        cited = self.rows.select("*", F.explode("premises").alias("p"))
        facts = cited.filter("p.kind = 'facts'").select("pred", "fid", "rule", "premises", F.col("p.pred").alias("c_pred"), F.explode("p.fids").alias("c_fid"))
        bad = facts.join(self.live(), (F.col("c_pred") == F.col("f_pred")) & (F.col("c_fid") == F.col("f_fid")), "left_anti").select("pred", "fid", "rule", "premises")
        groups = self.groups()
        if groups is not None:
            stale = cited.filter("p.kind = 'group'").join(groups, (F.col("p.pred") == F.col("g_pred")) & (F.col("p.key") == F.col("g_key")) & (F.col("p.sig") == F.col("g_sig")), "left_anti")
            bad = bad.union(stale.select("pred", "fid", "rule", "premises"))
        return bad

    def _step(self) -> tuple[bool, bool]:
        """Whether supports were lost, and whether facts were removed."""
        bad = written(self._bad().distinct())
        lost = not bad.isEmpty()
        if lost:
            self.rows = written(self.rows.subtract(bad))
        return lost, self._remove(self.live().filter("NOT f_base").join(self.rows.select(F.col("pred").alias("f_pred"), F.col("fid").alias("f_fid")), ["f_pred", "f_fid"], "left_anti"))

    def _remove(self, dead: DataFrame) -> bool:
        dead = written(dead.select("f_pred", "f_fid"))
        names = [r["f_pred"] for r in dead.select("f_pred").distinct().collect()]  # at most one row for each predicate
        for name in names:
            r = self.relations[name]
            r.replace(written(r.facts.join(dead.filter(F.col("f_pred") == name).select(F.col("f_fid").alias("_fid")), "_fid", "left_anti").select(*r.facts.columns)))
        if names:
            self.rows = written(self.rows.join(dead.select(F.col("f_pred").alias("pred"), F.col("f_fid").alias("fid")), ["pred", "fid"], "left_anti"))
        return bool(names)

    def _unfounded(self) -> bool:
        """Removes facts that no chain of supports leads back to base facts. Premises on groups count as founded."""
        live = self.live()
        if self.rows.isEmpty():
            return False
        founded = written(live.filter("f_base").select("f_pred", "f_fid"))
        need = self.rows.select("pred", "fid", F.monotonically_increasing_id().alias("s"), F.filter("premises", lambda p: p["kind"] == "facts").alias("premises"))
        need = written(need)
        cited = need.select("pred", "fid", "s", F.explode("premises").alias("p")).select("pred", "fid", "s", F.col("p.pred").alias("f_pred"), F.explode("p.fids").alias("f_fid"))
        free = need.filter(F.size("premises") == 0).select(F.col("pred").alias("f_pred"), F.col("fid").alias("f_fid"))
        founded = written(founded.union(free).distinct())
        while True:
            open_ = cited.join(founded, ["f_pred", "f_fid"], "left_anti").select("s").distinct()
            more = need.join(open_, "s", "left_anti").select(F.col("pred").alias("f_pred"), F.col("fid").alias("f_fid")).subtract(founded)
            more = written(more)
            if more.isEmpty():
                break
            founded = written(founded.union(more))
        return self._remove(live.join(founded, ["f_pred", "f_fid"], "left_anti"))


def _group_key(r: Relation):
    from stratalog.operators.relation import fact_id

    if not r.folds:
        return F.col("_fid")
    return fact_id(r.keys) if r.keys else F.lit("")
