"""A corpus pipeline: quality filter, exact and near deduplication, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Null
texts count as empty. Stages never read what an earlier one dropped. They decide on rows, as ids may be null or repeated: rows
of null id are scored, grouped, redacted and packed like others, and of exact repeats one row stays. Texts are read whole,
however long. Further columns of ``documents`` are left out. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.exact_dedup import exact_dedup
from stratalog.llm.near_dedup import near_dedup
from stratalog.llm.packing import pack_documents
from stratalog.llm.pii import redact_documents
from stratalog.llm.quality import fit_quality, keep_good
from stratalog.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.3. The model learns from labelled documents of this stage's input."""
    model = fit_quality(docs, common.table(spark, sf_dir, "labels"), common.remainder("doc_id", 5) != 0)
    return keep_good(docs.select(*COLUMNS), model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup(docs, carry=COLUMNS).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id; null ids come last."""
    # The key is written with the row, so that each scan reads the same. It is sorted and shuffled with the texts.
    keyed = common.written(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "keyed")
    groups = near_dedup(keyed, id_col="row").select("row", "component_id").join(keyed.select("row", "doc_id"), "row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return keyed.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; no document is dropped."""
    return redact_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 token ids, with the ids."""
    return pack_documents(docs, TOKENIZER, ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("pii", privacy), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{k}")
    return docs
