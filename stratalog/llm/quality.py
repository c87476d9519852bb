"""Document quality from a linear-chain conditional random field over lines.

Each line is described by its characters and words and by those of the lines around it. The field labels lines good or bad;
in training, lines of good documents are good, and those of bad documents bad unless a first field finds them unlike bad ones.
Length-weighted forward-backward marginals of a document's lines, and nothing else of it, give its score by a logistic
calibration. All of it is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.crf import Crf

#: Labelled documents to learn from, at most, and the lines that one of them has, at most.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 5000

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{}~/!"]] = 6
_CLASS[ord("|")] = 7
_BYTES = 7
WIDTH = 13


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, with those of the lines before and after; bytes of each line; bounds of the texts in lines.

    A text has one line more than line feeds, so an empty text has one empty line. Whether a line is the first or last counts
    little: else a document of one line would be judged by that alone.
    """
    data, offsets = common.raw_bytes(column)
    texts = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    # Lines begin at the texts' begins and after line feeds.
    owner = np.searchsorted(offsets, feeds, side="right") - 1
    counts = np.bincount(owner, minlength=texts) + 1
    bounds = np.append(0, np.cumsum(counts))
    begins = np.empty(bounds[-1], np.int64)
    is_first = np.zeros(bounds[-1], bool)
    is_first[bounds[:-1]] = True
    begins[is_first], begins[~is_first] = offsets[:-1], feeds + 1
    ends = np.empty_like(begins)
    is_last = np.zeros(bounds[-1], bool)
    is_last[bounds[1:] - 1] = True
    ends[is_last], ends[~is_last] = offsets[1:], feeds
    size = ends - begins
    kinds = _CLASS[data]
    share = np.empty((len(begins), _BYTES))
    for k in range(1, _BYTES + 1):
        before = np.append(0, np.cumsum(kinds == k, dtype=np.int32))
        share[:, k - 1] = before[ends] - before[begins]
    hashes, starts, _ = common.word_hashes(data, offsets, lower=False)
    word_at = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    words = np.maximum(word_at[1] - word_at[0], 0)
    again = np.append(0, np.cumsum(np.append(False, hashes[1:] == hashes[:-1]) if len(hashes) else np.zeros(0)))
    repeated = (again[word_at[1]] - again[np.minimum(word_at[0] + 1, word_at[1])]) / np.maximum(words, 1)
    n = np.maximum(size, 1)[:, None]
    own = np.concatenate([share / n, (repeated)[:, None], (words / n[:, 0])[:, None], np.log1p(size)[:, None] / 8, (words == 0)[:, None], (words == 1)[:, None], (share[:, :1] / np.maximum(share[:, :2].sum(1, keepdims=True), 1))], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([own, 0.5 * before, 0.5 * after, 0.25 * is_first[:, None], 0.25 * is_last[:, None], np.ones((len(own), 1))], axis=1), size, bounds


def document_features(p: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text, from the marginals of its lines alone: length-weighted mean, its root, weighted share of lines over one half."""
    weight = size + 1.0
    total = np.add.reduceat(weight, bounds[:-1])
    mean = lambda v: np.add.reduceat(v * weight, bounds[:-1]) / total
    bad = mean(p)
    return np.stack([bad, np.sqrt(bad), mean(p > 0.5), np.ones(len(total))], axis=1)


class QualityModel:
    """A field over lines, and a logistic calibration of what its marginals say of a document."""

    def __init__(self, field: Crf, weights: np.ndarray):
        self.field, self.weights = field, weights

    @classmethod
    def fit(cls, x: np.ndarray, size: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> QualityModel:
        if not len(good):
            return cls(Crf(np.zeros(3 * WIDTH + 3), np.zeros((2, 2))), np.zeros(4))
        share = np.where(good == 1, 1, max(1.0, good.sum() / max(1, (good == 0).sum())))
        of = np.repeat(good, np.diff(bounds))
        y = (of == 0).astype(np.int64)
        alone = np.arange(len(y) + 1)
        line_share = share[np.repeat(np.arange(len(good)), np.diff(bounds))]
        first = Crf.fit(x, y, alone, line_share / np.repeat(np.diff(bounds), np.diff(bounds)))
        y = y * (first.marginals(x, alone) > 0.5)
        field = Crf.fit(x, y, bounds, share)
        d = document_features(field.marginals(x, bounds), size, bounds)
        w, m, v = np.zeros(d.shape[1]), 0.0, 0.0
        for k in range(1, 401):
            slope = d.T @ (good - 1 / (1 + np.exp(-d @ w))) / len(good) - 1e-4 * w
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        return cls(field, w)

    def score(self, column: pa.Array) -> np.ndarray:
        x, size, bounds = line_features(column)
        d = document_features(self.field.marginals(x, bounds), size, bounds)
        return 1 / (1 + np.exp(-np.clip(d @ self.weights, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model of at most ``sample`` labelled documents, those of the smallest hashed ids; ``learn`` filters the labels.

    Only line features come to the driver. Null labels are left out; of repeated labels for an id the smallest counts, and of
    repeated rows the text of the smallest hash. Null ids and documents of more than ``SAMPLE_LINES`` lines are not learned
    from (they are scored like others). Without labelled documents, as with empty tables, every score is 0.5.
    """
    known = labels if learn is None else labels.filter(learn)
    chosen = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).filter(F.col("good").isNotNull())
    # At most ``sample`` rows: broadcast at any size of the input.
    chosen = chosen.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.filter(F.regexp_count("text", F.lit("\n")) < SAMPLE_LINES).groupBy("id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size, bounds = line_features(batch.column("text"))
        flat = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "good": batch.column("good"), "x": flat, "size": pa.array([size[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int64()))})

    got = common.map_text(rows, "text", kernel, "id long, good int, x binary, size array<long>").toArrow().sort_by([("id", "ascending")]).to_pydict()
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, 3 * WIDTH + 3) for b in got["x"]] or [np.zeros((0, 3 * WIDTH + 3))]).astype(np.float64)
    size = np.array([n for s in got["size"] for n in s], np.int64)
    return QualityModel.fit(x, size, np.append(0, np.cumsum([len(s) for s in got["size"]])).astype(np.int64), np.array(got["good"], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """One row per row: doc_id and a score from 0 to 1; null text counts as empty, an empty text is one empty line.

    Ids are only carried, null and repeated ones too. Texts are read whole, however long. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), out: pa.array(shared.value.score(batch.column("text")))})

    return common.map_text(rows, "text", kernel, f"doc_id long, {out} double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns, repeated rows too; an empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.score(batch.column(text_col)) >= least))

    return common.map_text(docs, text_col, kernel, docs.schema)
