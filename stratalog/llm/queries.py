"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import remainder, table
from stratalog.llm.exact_dedup import exact_dedup
from stratalog.llm.html_text import extract_text, page_model
from stratalog.llm.language import fit_language, identify_language
from stratalog.llm.media import media_features
from stratalog.llm.near_dedup import near_dedup
from stratalog.llm.packing import pack_documents
from stratalog.llm.pieces import encode_texts
from stratalog.llm.pii import find_pii
from stratalog.llm.quality import fit_quality, score_quality
from stratalog.llm.token_file import read_token_files, write_token_files

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
    PIECES = public_tokenizers.path("piece_bpe_32k.model")
except ModuleNotFoundError:  # the vocabulary files are a parameter of the operators
    TOKENIZER = PIECES = ""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    found = identify_language(docs, fit_language(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), page_model())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    found = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), redacted=False)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = write_token_files(table(spark, sf_dir, "documents"), TOKENIZER)
    return read_token_files(images).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), PIECES, ids=False)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_near_dedup": op5_near_dedup,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_token_files": op9_token_files,
    "op10_pieces": op10_pieces,
}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
