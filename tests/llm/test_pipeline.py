"""The pipeline's stages on a small corpus, each held against what it should drop, keep or change."""

import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("th er on an re ou ing ed".split()) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        rows.append([k, text(40).upper().replace(" ", "!! ") if bad else "\n".join(text(30) for _ in range(3))])
        labels.append((k, int(not bad), 0))
    copy = rows[1][1]
    near = copy.split(" ")
    near[10] = "other"
    rows += [[500, copy.replace(" ", "  ", 1)], [501, copy], [502, " ".join(near)], [503, text(60) + " a.b@c.org " + text(30)], [504, None], [505, ""]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, kept, str(tmp_path))
    assert good.columns == list(corpus_pipeline.COLUMNS)
    ids = {x["doc_id"] for x in good.collect()}
    assert {k for k in range(200) if k % 4} <= ids and not {k for k in range(0, 200, 4) if zlib.crc32(str(k).encode()) % 5 == 0} & ids
    once = stages["exact dedup"](spark, good, str(tmp_path))
    after = {x["doc_id"] for x in once.collect()}
    assert ids - after == {1, 501} | ({504, 505} & ids and {505} & ids)
    apart = {x["doc_id"] for x in stages["near dedup"](spark, once, str(tmp_path)).collect()}
    assert after - apart == {502} or after - apart == {500}
    clean = {x["doc_id"]: x for x in stages["pii"](spark, once, str(tmp_path)).collect()}
    assert "[EMAIL]" in clean[503]["text"] and clean[503]["n_chars"] == len(clean[503]["text"])
    before = {x["doc_id"]: x["text"] for x in once.collect()}
    assert sum(before[k] != clean[k]["text"] for k in before) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == apart
    assert all(x["length"] == len(x["ids"]) for x in packed)


def test_null_and_repeated_ids(spark, tmp_path):
    """The dedup stages decide on rows: none is lost for its null id, none comes back for sharing an id with one that stays."""
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    alone, twice, null_twice, one, two, long = (text() for _ in range(6))
    close = lambda t: t + " end"
    rows = [(None, alone), (1, twice), (1, twice), (1, twice), (None, null_twice), (None, null_twice), (2, one), (3, two), (2, two + " "), (3, one + "  "), (4, long), (4, close(long)), (None, close(close(long))), (None, None), (5, ""), (6, text())]
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact dedup"](spark, docs, str(tmp_path))
    assert once.columns == list(corpus_pipeline.COLUMNS)
    order = lambda found: sorted(found, key=repr)
    got = once.collect()
    # Of equal texts the longest stays, then the smallest id.
    want = [(None, alone), (1, twice), (None, null_twice), (3, one + "  "), (2, two + " "), (4, long), (4, close(long)), (None, close(close(long))), (5, ""), (6, rows[-1][1])]
    assert order((x["doc_id"], x["text"]) for x in got) == order(want)
    assert all(x["lang"] == (None if x["n_chars"] % 2 else "en") and x["source"] is None for x in got)
    near = stages["near dedup"](spark, once, str(tmp_path))
    assert near.columns == list(corpus_pipeline.COLUMNS)
    left = [(x["doc_id"], x["text"]) for x in near.collect()]
    family = {long, close(long), close(close(long))}
    assert order(x for x in left if x[1] not in family) == order(x for x in want if x[1] not in family)
    assert [x[0] for x in left if x[1] in family] == [4]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
