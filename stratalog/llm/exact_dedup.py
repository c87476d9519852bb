"""Exact deduplication with DataFrame operations only.

Texts are equal when identical after every white-space character of ``[\\x20\\x09-\\x0D]`` is deleted. Rows are grouped by a
128-bit content hash; inside a group the rows are sorted by their normalised text, so that the window's own byte comparison
keeps colliding texts apart. Keys that hold more than ``hot_share`` of all rows (there are at most 1 / hot_share of those)
are salted; their partial groups are merged afterwards through one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DELETED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _DELETED, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001, key: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, and with ``carry`` a struct ``row`` of these columns.

    Of equal texts the row with the most code points stays, then the smallest id; null ids come last. Null text counts as
    empty, and empty texts form one group. Of repeated rows (same id and text) exactly one is kept. An empty table gives an
    empty result. Other columns, whatever their names, are not read. An id may be null or repeated, so what is to be done with
    the rows that stay should be done with what they carry, not with their ids. ``key`` replaces the content hash, for tests.
    """
    source = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), *[F.struct(*carry).alias("row")] * bool(carry))
    held = ["row"] * bool(carry)
    rows = source.select("*", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")).withColumn("key", key if key is not None else F.substring("sha", 1, 32))
    most = max(1, int(docs.count() * hot_share))
    # At most 1 / hot_share keys can hold more rows than that: small at any size of the input.
    hot = rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).alias("salts"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))))
    group = Window.partitionBy("key", "salt", "norm")
    order = [F.col("n").desc(), F.col("id").isNull(), F.col("id")]

    def grouped(part: DataFrame) -> DataFrame:
        return part.repartition("key", "salt").select(
            "id", "sha", "key", "salt", "norm", "n", F.row_number().over(group.orderBy(*order)).alias("rank"), F.first("id").over(group.orderBy(*order)).alias("head"), F.count("*").over(group).alias("size"), *[x for x in held if x in part.columns]
        )

    heads = grouped(dealt.filter(F.col("salt").isNotNull()).drop("row")).filter("rank = 1")
    whole = Window.partitionBy("key", "norm")
    merged = heads.select(
        F.col("key").alias("hot_key"), F.col("salt").alias("hot_salt"), F.col("head").alias("hot_head"),
        F.first("head").over(whole.orderBy(*order)).alias("all_head"), F.sum("size").over(whole).alias("all_size"), (F.row_number().over(whole.orderBy(*order)) == 1).alias("all_first"),
    )
    same = (F.col("key") == F.col("hot_key")) & (F.col("salt") == F.col("hot_salt")) & F.col("head").eqNullSafe(F.col("hot_head"))
    # One row for each salted part of a hot group: at most 2 / hot_share, but for collisions.
    joined = grouped(dealt).drop("norm", "n").join(F.broadcast(merged), same, "left")
    is_hot = F.col("hot_key").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(is_hot, F.col("all_head")).otherwise(F.col("head")).alias("keep_id"),
        F.when(is_hot, F.col("all_size")).otherwise(F.col("size")).cast("long").alias("group_size"),
        ((F.col("rank") == 1) & F.coalesce("all_first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *held,
    )
