"""Streams of facts: each micro-batch is inserted and the rules run on what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.database import Database
from stratalog.functions.types import struct_type
from stratalog.sources.tables import as_facts


def feed(db: Database, pred: str, stream: DataFrame, checkpoint: str, mapping: dict | None = None, then: Callable[[Database, int], None] | None = None) -> StreamingQuery:
    """Starts feeding a stream to a predicate. A batch that is delivered again changes nothing, as facts are sets.

    The facts of each batch are kept in the folder ``facts`` beside the stream's own checkpoint, and a stream that is started
    again from it, with a new database, first inserts those. ``then`` is called after each batch, for example to write
    ``db.query_incr(...)`` to a sink.
    """
    relation = db.relation(pred)
    kept = f"{checkpoint.rstrip('/')}/facts"
    # An own row keeps the folder readable before the first batch; it has number -1 and is never inserted.
    schema = struct_type([*relation.kinds, ("_batch", "bigint")])
    db.spark.createDataFrame([(*[None] * len(relation.kinds), -1)], schema).write.mode("overwrite").parquet(f"{kept}/none")
    before = db.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(kept).filter("_batch >= 0").drop("_batch")
    if not before.isEmpty():
        db.insert(pred, before)
        db.run_rules()

    def batch(rows: DataFrame, number: int) -> None:
        facts = as_facts(db.spark, relation.pred, rows, db.types, mapping)
        facts.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{kept}/{number}")
        db.insert(pred, db.spark.read.schema(schema).parquet(f"{kept}/{number}").drop("_batch"))
        db.run_rules()
        if then:
            then(db, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").start()
