"""Language identification with string kernels.

The kernel of two texts is the mean over n of their common distinct character n-grams, n = 1 to 3, over the geometric mean
of their numbers of distinct n-grams. Texts are compared with a few landmark texts only (Nyström); one-versus-rest
kernel ridge regression on those features gives a margin for each language. A batch of texts becomes a presence matrix over
the landmarks' n-grams, and all kernels and margins of the batch are matrix products. Letters of all scripts are told apart:
n-grams of code points are hashed into 2^21 places, where two may rarely share one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm import common

#: Landmark texts and labelled rows to learn from, of each language at most; landmarks are of so many characters, if there are any.
LANDMARKS_EACH, SAMPLE_EACH, LANDMARK_CHARS = 12, 300, 20_000
ORDERS, PLACE_BITS = 3, 21
_LETTER = re.compile(r"[^\W\d_]")
#: A number for each letter; whatever is no letter shares 0.
_CLASS = np.array([k if chr(k).isalpha() else 0 for k in range(0x110000)], np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class LanguageModel:
    """``columns``: presence column of each n-gram's place, or -1."""

    languages: list[str]
    columns: list[np.ndarray]
    landmarks: list[np.ndarray]  # for each n: presence of n-grams in landmarks
    sizes: np.ndarray  # distinct n-grams of landmarks, by n
    weights: np.ndarray | None = None  # from kernels and 1 to margins
    heat: float = 4.0

    def grams(self, text: str) -> list[np.ndarray]:
        """Places of the distinct n-grams for each n over the whole text, with a border at either end."""
        codes = _codes(text)
        c = np.zeros(len(codes) + 2, np.uint32)
        c[1:-1] = _CLASS[codes]
        out, gram, seen = [], c, _scratch(1 << PLACE_BITS)
        order = np.arange(len(c), dtype=np.int32)
        for n in range(1, ORDERS + 1):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACE_BITS)
            seen[place] = order[: len(place)]
            out.append(place[seen[place] == order[: len(place)]])
        return out

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of texts with all landmarks."""
        sets = [self.grams(t) for t in texts]
        out = np.zeros((len(texts), len(self.sizes)))
        for n in range(ORDERS):
            present = np.zeros((len(texts), self.landmarks[n].shape[1]), np.float32)
            for k, s in enumerate(sets):
                at = self.columns[n][s[n]]
                present[k, at[at >= 0]] = 1
            own = np.array([max(1, len(s[n])) for s in sets])
            out += (present @ self.landmarks[n].T) / np.sqrt(np.outer(own, np.maximum(self.sizes[:, n], 1)))
        return out / ORDERS

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without a letter or without anything learned."""
        lettered = np.array([_LETTER.search(t) is not None for t in texts], bool)
        if self.weights is None or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        k = self.kernels(texts)
        margins = self.heat * (np.concatenate([k, np.ones((len(k), 1))], 1) @ self.weights)
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(axis=1), 0.0)


_scratches: dict[int, np.ndarray] = {}


def _scratch(n: int) -> np.ndarray:
    if n not in _scratches:
        _scratches[n] = np.zeros(n, np.int32)
    return _scratches[n]


def landmark_model(languages: list[str], texts: list[str]) -> LanguageModel:
    """A model without weights: the landmarks' n-grams."""
    model = LanguageModel(languages, [], [], np.zeros((len(texts), ORDERS)))
    sets = [model.grams(t) for t in texts]
    for n in range(ORDERS):
        known = np.unique(np.concatenate([s[n] for s in sets])) if sets else np.zeros(0, np.int64)
        columns = np.full(1 << PLACE_BITS, -1, np.int32)
        columns[known] = np.arange(len(known))
        present = np.zeros((len(sets), len(known)), np.float32)
        for k, s in enumerate(sets):
            present[k, columns[s[n]]] = 1
        model.columns.append(columns)
        model.landmarks.append(present)
        model.sizes[:, n] = [len(s[n]) for s in sets]
    return model


def ridge(model: LanguageModel, landmark_texts: list[str], kernels: np.ndarray, langs: list[str], l2: float = 1e-3) -> LanguageModel:
    """Weights by Nyström features and one-versus-rest ridge regression."""
    if not len(langs):
        return model
    own = model.kernels(landmark_texts)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([kernels @ whiten, np.ones((len(kernels), 1))], 1)
    target = np.array([[1.0 if x == y else -1.0 for y in model.languages] for x in langs])
    share = 1 / np.maximum(1, (target > 0).sum(0))
    w = share[target.argmax(1)][:, None]
    a = np.linalg.solve(phi.T @ (w * phi) + l2 * np.eye(phi.shape[1]), phi.T @ (w * target))
    model.weights = np.concatenate([whiten @ a[:-1], a[-1:]])
    return model


def fit_language(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE_EACH, each: int = LANDMARKS_EACH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of at most ``sample`` labelled rows of each language, of which at most ``each`` are landmarks.

    Rows are taken by the order of a hash of id and text, so repeated and null ids are rows like others. Rows without text or
    language are not learned from; without any, every text is ``und``. A language is learned however rare it is.
    """
    spark = docs.sparkSession
    known = docs.filter(learn) if learn is not None else docs
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # One row for each language.
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    # About twice the rows that are needed, by a threshold on the hash: no language meets in one task before that.
    few = (F.col("h").cast("double") / 2.0**63 + 1) / 2 < 2.0 * sample / F.col("rows")
    picked = common.written(known.join(F.broadcast(counts), "lang").filter(few).drop("rows"), "language-picked")
    ranked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= sample)
    by_size = Window.partitionBy("lang").orderBy(F.char_length("text") > LANDMARK_CHARS, "rank")
    rows = common.written(ranked.withColumn("mark", F.row_number().over(by_size) <= each), "language-sample")
    # At most ``each`` texts of a language.
    marks = sorted(rows.filter("mark").select("lang", "rank", "text").collect())
    if not marks:
        return LanguageModel([], [], [], np.zeros((0, ORDERS)))
    landmark_texts = [r["text"] for r in marks]
    model = landmark_model(sorted({r["lang"] for r in marks}), landmark_texts)
    shared = spark.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = shared.value.kernels(common.texts_of(batch, "text"))
        return pa.RecordBatch.from_pydict({"rank": batch.column("rank"), "lang": batch.column("lang"), "k": pa.array(list(k), pa.list_(pa.float64()))})

    # At most ``sample`` rows of a language, with a number for each landmark.
    got = sorted(common.map_text(rows.select("rank", "lang", "text"), "text", kernel, "rank int, lang string, k array<double>").collect())
    return ridge(model, landmark_texts, np.array([r["k"] for r in got]), [r["lang"] for r in got])


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score. Null texts and texts without a letter are ``und`` with score 0.

    Ids are only carried, null and repeated ones too. Texts are read whole, however long: a kernel takes memory in proportion
    to one text. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(common.texts_of(batch, "text"))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return common.map_text(rows, "text", kernel, "doc_id long, lang_pred string, score double")
