"""SentencePiece encoding and decoding as a relational lattice.

A text becomes words: it is cut wherever no piece reaches over. Over the distinct words of all texts, all substrings up to the
longest piece are exploded and equi-joined to the piece table; a word's matches are its lattice edges, grouped by word. A
higher-order aggregate folds the lattice by Viterbi: at each place it keeps the best path that ends there.

The given model is a byte-pair model. The path with the greatest sum of its scores is not what the model encodes, so transitions
are scored, not edges: a piece may follow another only if the model would leave the two side by side, that is, if no edge across
their border would have been merged first. Under such transitions one path is left at every place, and it is the model's own
encoding (tests hold it against the library). Whether two pieces may meet is read from three arrays of the piece table, by
length: when the last part of the left piece, and the first part of the right one, is merged away, and when the edge across
the border could be merged. Characters without a piece become byte pieces.

Texts are encoded by joining their words to the encoded words. Texts do not move: what moves is a code for each word, the most
frequent words by place in a broadcast table of bounded size, and all others spelled out and joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common

#: Words in the broadcast table, at most; longest word that the lattice takes; words that a task counts before it hands them on.
FREQUENT, LONGEST, HELD = 1_000_000, 256, 400_000
#: Distinct words in a partition of the lattice, about.
WORDS_EACH = 24_000
#: Characters of text in a group of the last join, about.
GROUP_CHARS = 16 << 20
MARK = "▁"
#: When what is never merged away is merged, and when what can't be merged is.
_END, _NEVER = 1 << 30, (1 << 31) - 1
_NONE = "CAST(array() AS array<int>)"


class Model:
    """The pieces of a model file; ``rank`` is the order in which merges are made, from 1, and a space stands for the mark."""

    def __init__(self, path: str):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        place = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in plain}), 1)}
        self.ids = {sp.id_to_piece(i).replace(MARK, " "): i for i in plain}
        self.rank = {p: place[-sp.get_score(i)] for p, i in self.ids.items()}
        self.first_byte = next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))
        special = lambda i: bytes([i - self.first_byte]) if sp.is_byte(i) else b""
        spelled = {i: p.encode() for p, i in self.ids.items()}
        self.spelled = [spelled[i] if i in spelled else special(i) for i in range(sp.get_piece_size())]
        glued = np.zeros(1 << 16, bool)
        for p in self.ids:
            b = np.frombuffer(p.encode(), np.uint8).astype(np.int64)
            glued[b[:-1] * 256 + b[1:]] = True
        #: Whether a text may be cut between two bytes; never inside a character.
        self.cut = ~glued
        self.cut.reshape(256, 256)[:, 0x80:0xC0] = False

    def parts(self, piece: str) -> list[tuple]:
        """What merging makes of a piece alone, as trees (text, left, right)."""
        a: list[tuple] = [(c, None, None) for c in piece]
        while len(a) > 1:
            found = [(r, k) for k in range(len(a) - 1) if (r := self.rank.get(a[k][0] + a[k + 1][0])) is not None]
            if not found:
                break
            k = min(found)[1]
            a[k : k + 2] = [(a[k][0] + a[k + 1][0], a[k], a[k + 1])]
        return a

    def made(self, part: str) -> int:
        """When a part comes to be: characters are there from the start."""
        return 0 if len(part) == 1 else self.rank.get(part, _NEVER)

    def table(self) -> list[tuple[str, int, list[int], list[int], list[int]]]:
        """(piece, id, left, right, over). Entry n - 1 of ``left``: when the first part of n characters is merged away, -1 if there is
        none; of ``right`` the same for the last part; of ``over``: when the piece could be merged over a border after n characters.
        """
        rows = []
        for piece, i in self.ids.items():
            tree = self.parts(piece)
            if len(tree) > 1:
                continue  # the model never makes it

            def ends(side: int, node: tuple = tree[0], n: int = len(piece)) -> list[int]:
                out = [-1] * n
                out[n - 1] = _END
                while node[1] is not None:
                    when, node = self.rank[node[0]], node[1 + side]
                    out[len(node[0]) - 1] = when
                return out

            over = [max(self.rank[piece], self.made(piece[:k]), self.made(piece[k:])) for k in range(1, len(piece))]
            rows.append((piece, i, ends(0), ends(1), over))
        return rows

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, and the texts' bounds in them. The mark before a text, and in it, is a space."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        data, offsets = common.raw_bytes(texts)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
        begins = np.ones(len(data), bool)
        begins[1:] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return words, np.searchsorted(starts, offsets)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def string_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; none is empty."""
    data, offsets = common.raw_bytes(column)
    if not len(data):
        return np.zeros(len(column), np.uint64)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    return common.mix(np.add.reduceat(common._BYTE[data] * common.powers(int(sizes.max()))[place], offsets[:-1]) + sizes.astype(np.uint64))


class WordTable:
    """Ids of words, in flat arrays; words are found by hash, and words that share one are not in the table."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        h = string_hashes(words)
        order = np.argsort(h, kind="stable")
        h = h[order]
        alone = np.ones(len(h), bool)
        if len(h):
            alone[1:] &= h[1:] != h[:-1]
            alone[:-1] &= h[1:] != h[:-1]
        self.hashes, self.places = h[alone], order[alone]
        self.offsets, self.pool = np.asarray(ids.offsets).astype(np.int32), np.asarray(ids.flatten(), dtype=np.uint16)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the table, or -1."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1, np.int64)
        h = string_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.places[at], -1)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, merges): ``merges`` are left, right and over of ``Model.table`` in a row. As many rows as the model has pieces."""
    return spark.createDataFrame([(piece, i, left + right + over) for piece, i, left, right, over in model(path).table()], "piece string, id long, merges array<int>")


def encode_words(words: DataFrame, path: str, each: int = WORDS_EACH) -> DataFrame:
    """(word, n) to (word, n, ids), with about ``each`` words in a partition. Words are distinct and not empty."""
    spark, m = words.sparkSession, model(path)
    most = max(map(len, m.ids))
    parts = max(common.partitions(spark), -(-words.count() // each))
    # Edges of a word are made next to each other and in the order of its lattice, so both sorts, by its number and inside it, find them in order.
    dealt = words.select("word", "n").repartition(parts, "word")
    numbered = dealt.select(F.monotonically_increasing_id().alias("w"), "word", "n", F.char_length("word").alias("size"))
    ends = numbered.select("w", "word", "n", F.explode(F.expr("sequence(1, size)")).alias("e"))
    spans = ends.select("*", F.explode(F.expr(f"sequence(greatest(0, e - {most}), e - 1)")).alias("s")).withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    edges = spans.join(F.broadcast(piece_table(spark, path)), "piece", "left").filter("id IS NOT NULL OR e = s + 1")
    # An edge in one number (end, start, id; no id for a character without a piece), and its merges.
    edge = F.struct(F.expr("shiftleft(CAST(e AS bigint), 40) + shiftleft(CAST(s AS bigint), 24) + coalesce(id, 16777215L)").alias("k"), F.coalesce("merges", F.array(F.lit(_END), F.lit(_END))).alias("m"))
    lattice = edges.groupBy("w", "word", "n").agg(F.sort_array(F.collect_list(edge)).alias("g"))
    unpacked = "transform(g, (x, n) -> named_struct('n', n, 'e', CAST(shiftright(x.k, 40) AS int), 's', CAST(shiftright(x.k, 24) & 65535 AS int), 'id', CAST(x.k & 16777215 AS int), 'm', x.m))"
    # ``done`` holds for each place up to now the number of the best path's last edge. Edge a before it and edge b are barred if
    # an edge c over their border could be merged before the part of a, and no later than the part of b, that it takes is merged.
    a, over = "get(g, get(done, b.s - 1))", "get(c.m, 2 * (c.e - c.s) + b.s - c.s - 1)"
    barred = f"exists(h, c -> c.s < b.s AND c.e > b.s AND c.e <= b.e AND {a}.s <= c.s AND {over} < get({a}.m, b.s - {a}.s + b.s - c.s - 1) AND {over} <= get(b.m, c.e - b.s - 1))"
    as_bytes = f"transform(sequence(1, octet_length(substring(word, t.e, 1))), k -> CAST(conv(substring(hex(encode(substring(word, t.e, 1), 'UTF-8')), 2 * k - 1, 2), 16, 10) AS int) + {m.first_byte})"
    # Back from the last place: the ids of the edges of its path; ``at`` is where the next one ends.
    before = _let("t", "get(g, d)", f"named_struct('at', t.s, 'ids', concat(IF(t.id < 16777215, array(t.id), {as_bytes}), y.ids))")
    ids = f"aggregate(reverse(done), named_struct('at', size(done), 'ids', {_NONE}), (y, d) -> IF(get(g, d).e = y.at, {before}, y), y -> y.ids)"
    folded = f"aggregate(g, {_NONE}, (done, b) -> IF(size(done) >= b.e OR b.s > 0 AND {barred}, done, concat(done, array(b.n))), done -> {ids})"
    return lattice.select("word", "n", F.expr(_let("g", unpacked, _let("h", "filter(g, c -> c.e > c.s + 1)", folded))).alias("ids"))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with a name for ``value``, by the end of a fold over nothing: ``transform`` over an array of one would copy the value."""
    return f"aggregate({_NONE}, {value}, ({name}, _) -> {name}, {name} -> {body})"


def whole_word(word: str, sp: sentencepiece.SentencePieceProcessor) -> list[int]:
    """Ids of a long word by the library.

    The library puts a mark before a text: a word that begins with one lends its own, for others a line feed is put before and
    its ids are taken off.
    """
    return sp.encode(word[1:]) if word.startswith(" ") else sp.encode("\n" + word)[len(sp.encode("\n")) :]


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes under 2^28, seven bits a byte, the last byte of each with the high bit set; compressed."""
    sizes = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = sizes > k
        out[ends[has] - 1 - k] = (codes[has] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return zstandard.compress(out.tobytes(), 1)


def unpack_codes(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    ends = np.flatnonzero(data & 128)
    sizes = np.diff(np.append(-1, ends))
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = sizes > k
        out[has] |= (data[ends[has] - k].astype(np.int64) & 127) << (7 * k)
    return out


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """One row per row: doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip, and with ``ids`` the piece ids.

    ``decoded_sha256`` is of the text that the ids decode to; ``round_trip`` tells whether it equals the text, which is so
    unless the text holds U+2581 itself. Null text counts as empty and has no piece. Rows of null or repeated ids are
    encoded like others. Words of more than 256 characters (runs that no cut divides) are given to the library, so that no
    lattice grows without bound. An empty table gives no row.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for piece in common.pieces(batches, "text"):
            words, _ = model(path).units(piece.column("text"))
            found = words.value_counts()
            one = pa.table({"word": found.field(0), "n": found.field(1)})
            held.append(one.filter(pc.less_equal(pc.utf8_length(one["word"]), LONGEST)))
            if sum(map(len, held)) > HELD:
                held = [merged()]
                if len(held[0]) > HELD // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    held = []
        if held:
            yield from merged().combine_chunks().to_batches(max_chunksize=1 << 16)

    counted = common.written(rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    encoded = common.written(encode_words(counted, path), "words")
    # Counts in bins of eight for each power of two: a few hundred rows at any size.
    bins = sorted(((r["bin"], r["words"], r["chars"]) for r in encoded.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count("*").alias("words"), F.sum(F.col("n") * F.length("word")).alias("chars")).collect()), reverse=True)
    least, total = None, 0
    for b, n, _ in bins:
        total += n
        if total > frequent:
            break
        least = b
    groups = max(common.partitions(spark), -(-sum(c for *_, c in bins) // GROUP_CHARS))
    # At most ``frequent`` words.
    known = encoded.filter(F.floor(8 * F.log2("n")) >= (least if least is not None else 1 << 30)).select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    shared = spark.sparkContext.broadcast(_table(known))
    dealt = rows.withColumn("k", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            words, bounds = model(path).units(piece.column("text"))
            found = words.dictionary_encode()
            unknown = (shared.value.find(found.dictionary) < 0) & np.asarray(pc.less_equal(pc.utf8_length(found.dictionary), LONGEST))
            if unknown.any():
                index = np.asarray(found.indices)
                hit = np.flatnonzero(unknown[index])
                group = np.asarray(piece.column("k"))[np.searchsorted(bounds, hit, side="right") - 1]
                pairs = np.unique(group.astype(np.int64) << 32 | index[hit])
                yield pa.RecordBatch.from_pydict({"k": pa.array((pairs >> 32).astype(np.int32)), "word": found.dictionary.take(pa.array(pairs & 0xFFFFFFFF))})

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            words, bounds = model(path).units(piece.column("text"))
            found = words.dictionary_encode()
            codes = (shared.value.find(found.dictionary) + 1)[np.asarray(found.indices)]
            spelled = np.flatnonzero(codes == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(spelled, bounds).astype(np.int32)), words.take(pa.array(spelled)))
            packed = [pack_codes(codes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            shas = [hashlib.sha256(t.encode()).digest() for t in common.texts_of(piece, "text")]
            yield pa.RecordBatch.from_pydict({"k": piece.column("k"), "doc_id": piece.column("doc_id"), "codes": pa.array(packed, pa.binary()), "rare": lists, "sha": pa.array(shas, pa.binary())})

    others = dealt.select("k", "text").mapInArrow(rare, "k int, word string").distinct().join(encoded.select("word", "ids"), "word")
    moved = dealt.mapInArrow(coded, "k int, doc_id long, codes binary, rare array<string>, sha binary")

    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        own = _table(words)
        strays = dict(zip(words.column("word").to_pylist(), words.column("ids").to_pylist(), strict=True)) if len(own.hashes) < words.num_rows else {}
        out = [_decoded(batch, shared.value, own, strays, model(path), ids) for batch in docs.to_batches(max_chunksize=256)]
        return pa.Table.from_batches(out, schema=_schema(ids))

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return moved.groupBy("k").cogroup(others.groupBy("k")).applyInArrow(join, schema)


def _table(rows: pa.Table) -> WordTable:
    one = rows.select(["word", "ids"]).cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
    first = lambda x, kind: x.chunk(0) if x.num_chunks else pa.array([], kind)
    return WordTable(first(one["word"], pa.string()), first(one["ids"], pa.list_(pa.int32())))


def _schema(ids: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), *[("ids", pa.list_(pa.int32()))] * ids])


def _decoded(batch: pa.RecordBatch, table: WordTable, own: WordTable, strays: dict[str, list[int]], m: Model, ids: bool) -> pa.RecordBatch:
    """The result rows of coded documents: ids from the two tables, then the text from the ids."""
    each = [unpack_codes(c.as_py()) for c in batch.column("codes")]
    codes = np.concatenate(each) - 1
    bounds = np.append(0, np.cumsum(list(map(len, each))))
    rare = batch.column("rare").flatten().cast(pa.string()).dictionary_encode()
    place = own.find(rare.dictionary)
    extra: list[int] = []
    extra_ends = [0]
    for j in np.flatnonzero(place < 0).tolist():
        word = rare.dictionary[j].as_py()
        extra += strays[word] if word in strays else whole_word(word, m.library)
        place[j] = len(own.offsets) - 1 + len(extra_ends) - 1
        extra_ends.append(len(extra))
    # All lists of ids in a row: the broadcast table's, the group's own, and those made here.
    values = np.concatenate([table.pool, own.pool, np.array(extra, np.uint16)])
    base, base_own = len(table.pool), len(table.pool) + len(own.pool)
    ends = np.concatenate([table.offsets, base + own.offsets[1:], base_own + np.array(extra_ends[1:], np.int64)]).astype(np.int32)
    codes[codes < 0] = len(table.offsets) - 1 + place[np.asarray(rare.indices)]
    taken = pa.ListArray.from_arrays(pa.array(ends), pa.array(values)).take(pa.array(codes))
    flat, cuts = np.asarray(taken.values).astype("<u4"), np.asarray(taken.offsets)[bounds]
    spelled = pa.array(m.spelled, pa.binary()).take(pa.array(flat))
    data, at = spelled.buffers()[2], np.asarray(pa.Array.from_buffers(pa.int32(), len(spelled) + 1, [None, spelled.buffers()[1]]))[cuts]
    view = memoryview(data) if data is not None else memoryview(b"")
    rows = []
    for k, sha in enumerate(batch.column("sha").to_pylist()):
        a, b = int(at[k]), int(at[k + 1])
        # The mark before the text is taken off.
        decoded = hashlib.sha256(view[a + (view[a:b][:1] == b" ") : b]).digest()
        rows.append((int(cuts[k + 1] - cuts[k]), common.crc(flat[cuts[k] : cuts[k + 1]].tobytes()), decoded.hex(), decoded == sha))
    n, crcs, shas, same = zip(*rows, strict=True)
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas), pa.array(same)]
    if ids:
        columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, schema=_schema(ids))


__all__ = ["Model", "encode_texts", "encode_words", "piece_table"]
