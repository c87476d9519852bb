"""Near-duplicate documents: MinHash signatures joined through inverted lists of their coordinates.

1. A document's set holds its distinct 5-word shingles. Documents of equal sets form a class; only classes go on.
2. A class has a signature of 64 coordinates. It is posted under each coordinate-value pair. Pairs that only one class has
   are dropped. The rest of a class's list is ordered from rare to common values, and only the prefix is kept that two
   classes with ``MATCHES`` equal coordinates must share: COORDS - MATCHES + 1 places, of which unshared values take the first.
3. Each posting list first links its classes with one of them (its hub), not with each other. The hub is the most central class:
   the one whose coordinates are shared most, as the text that the others were copied from. Pairs with at least
   ``MATCHES`` equal coordinates are confirmed on their full sets, and confirmed links joined to components.
4. Lists whose classes now lie in one component need nothing more. The classes of all others are dealt into blocks of bounded
   size, by component or, for small components, by the hub they share. Two blocks meet if some list has classes of different
   components in them. There the prefixes' posting lists are merged, which gives the candidates; collisions in the long lists
   are counted by binary search for these alone, and a pair is skipped once it can no longer reach ``MATCHES``. Pairs that
   reach it are confirmed on their full sets, and of the links only those that join components leave the task. So no pair is
   lost, and groups of copies or near misses never give a row for each pair.

A pair at similarity 0.75 has 48 equal coordinates of 64 on average; it falls below 34 with a probability of about 3e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common

WORDS, PERCENT, COORDS, MATCHES = 5, 75, 64, 34
#: Classes in a block, and their shingles together: about 2 MB of text, unless one text alone is longer.
BLOCK, BLOCK_SHINGLES = 128, 300_000
#: Places of a posting list's order that are probed before pairs out of reach are skipped.
STRIDE = 8

_RNG = np.random.default_rng(64)
_PLACES = _RNG.integers(1, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_FACTORS = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in a row, and the texts' bounds in them."""
    data, offsets = common.raw_bytes(column)
    h, _, bounds = common.word_hashes(data, offsets)
    counts = np.diff(bounds)
    rows = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    ends = np.cumsum(rows)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    if not len(out):
        return out, np.append(0, ends)
    if len(h) >= WORDS:
        every = sum(h[j : len(h) - WORDS + 1 + j] * _PLACES[j] for j in range(WORDS))
        long = counts >= WORDS
        at = np.repeat(bounds[:-1][long] - (ends - rows)[long], rows[long])
        place = np.flatnonzero(np.repeat(long, rows))
        out[place] = every[place + at]
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
        own = h[bounds[d] : bounds[d + 1]]
        out[ends[d] - 1] = np.append(own * _PLACES[: len(own)], _PLACES[WORDS : WORDS + 1] * np.uint64(len(own))).sum()
    out = common.mix(out)
    starts = ends - rows
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[rows > 0]] = True
    kept = np.append(0, np.cumsum(new))
    return out[new], np.append(0, kept[ends])


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDS minima for each non-empty set."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), COORDS), np.int32)
    for k in range(COORDS if len(full) else 0):
        values = ((sets ^ _MASKS[k]) * _FACTORS[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(values, bounds[:-1][full]).astype(np.uint32).view(np.int32)
    return out


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, n, digest, signature) of each row; digest and signature are null for empty sets."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        digests = [hashlib.blake2b(sets[a:b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        found = signatures(sets, bounds)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((n > 0) * COORDS)).astype(np.int32)), pa.array(found.reshape(-1)))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "signature": lists})

    return common.map_text(rows, "text", kernel, "id long, n long, digest binary, signature array<int>")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted hashes, both with elements, share enough of their union."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    spark = rows.sparkSession
    texts = rows.filter(F.col("id").isNotNull())
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first, where = np.unique(np.asarray(batch.column("b")), return_index=True, return_inverse=True)
        sets_a, at_a = shingle_sets(batch.column("text_a"))
        sets_b, at_b = shingle_sets(batch.column("text_b").take(pa.array(first)))
        ok = [similar(sets_a[at_a[k] : at_a[k + 1]], sets_b[at_b[j] : at_b[j + 1]], percent) for k, j in enumerate(where.tolist())]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Lets Spark test the texts' ids against a Bloom filter of the pairs' ids, of bounded size, before it moves texts.
    with common.setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0"):
        return common.written(common.map_text(both, "text_a", kernel, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Each round maps nodes to their smallest neighbour and that one's own, then contracts the edges. No edge reaches the
    driver. Without edges there is no row.
    """
    left = common.written(edges.filter("a <> b").distinct(), "edges")
    labels = common.written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        parents = common.written(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "parents")
        again = parents.select(F.col("node").alias("p"), F.col("p").alias("q"))
        steps = common.written(parents.join(again, "p").select("node", "q"), "steps")
        of_a, of_b = steps.select(F.col("node").alias("a"), F.col("q").alias("qa")), steps.select(F.col("node").alias("b"), F.col("q").alias("qb"))
        left = common.written(left.join(of_a, "a").join(of_b, "b").filter("qa <> qb").select(F.col("qa").alias("a"), F.col("qb").alias("b")).distinct(), "edges")
        labels = common.written(labels.join(steps.select(F.col("node").alias("component"), "q"), "component", "left").select("node", F.coalesce("q", "component").alias("component")), "labels")
    return labels


def collisions(keys_a: list[np.ndarray], prefix_a: list[int], keys_b: list[np.ndarray], prefix_b: list[int], matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two sides with at least ``matches`` keys in common, given each one's keys from rare to common and its prefix's length.

    The short lists, those of the prefixes, are merged; the long ones are only searched for the pairs that this gives.
    """
    owner_b = np.repeat(np.arange(len(keys_b)), prefix_b)
    short_b = np.concatenate([k[:n] for k, n in zip(keys_b, prefix_b, strict=True)])
    order = np.argsort(short_b, kind="stable")
    owner_b, short_b = owner_b[order], short_b[order]
    owner_a = np.repeat(np.arange(len(keys_a)), prefix_a)
    short_a = np.concatenate([k[:n] for k, n in zip(keys_a, prefix_a, strict=True)])
    low = np.searchsorted(short_b, short_a)
    runs = np.searchsorted(short_b, short_a, side="right") - low
    ends = np.cumsum(runs)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - runs - low, runs)
    pairs = np.unique(np.repeat(owner_a, runs) * len(keys_b) + owner_b[at])
    i, j = np.divmod(pairs, len(keys_b))
    # A class and a key in one number: a key takes 38 bits.
    sizes = np.array([len(k) for k in keys_a])
    flat_a, start = np.concatenate(keys_a), np.cumsum(sizes) - sizes
    flat_b = np.sort(np.concatenate([k + (np.int64(c) << 38) for c, k in enumerate(keys_b)]))
    count = np.zeros(len(i), np.int64)
    for first in range(0, int(sizes.max(initial=0)), STRIDE):
        for place in range(first, first + STRIDE):
            there = place < sizes[i]
            wanted = flat_a[start[i[there]] + place] + (j[there] << 38)
            count[there] += flat_b[np.minimum(np.searchsorted(flat_b, wanted), len(flat_b) - 1)] == wanted
        within = count + np.maximum(sizes[i] - first - STRIDE, 0) >= matches
        i, j, count = i[within], j[within], count[within]
    return i, j


def _linked(block_a: dict, block_b: dict, percent: int, matches: int, cache: dict) -> list[tuple[int, int]]:
    """Links between the classes of two blocks that join components."""

    def loaded(block: dict) -> tuple:
        if block["block"] not in cache:
            while len(cache) > 3:
                cache.pop(next(iter(cache)))
            members = block["members"]
            sets, bounds = shingle_sets(pa.array([m["text"] for m in members], pa.string()))
            keys = [np.array(m["keys"], np.int64) for m in members], [m["prefix"] for m in members]
            cache[block["block"]] = [sets[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], keys, [m["rep"] for m in members], [m["component"] for m in members]
        return cache[block["block"]]

    (sets_a, keys_a, ids_a, ca), (sets_b, keys_b, ids_b, cb) = loaded(block_a), loaded(block_b)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in collisions(*keys_a, *keys_b, matches)), strict=True):
        x, y = root(ca[i]), root(cb[j])
        if x != y and similar(sets_a[i], sets_b[j], percent):
            up[x] = y
            out.append((ids_a[i], ids_b[j]))
    return out


def _between(own: DataFrame, prefixes: DataFrame, hub_of: DataFrame, labels: DataFrame, rows: DataFrame, percent: int, matches: int, size: int) -> DataFrame:
    """Links (a, b) between classes of different components that share a list."""
    spark = rows.sparkSession
    placed = prefixes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    placed = common.written(placed, "placed")
    mixed = common.written(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "mixed")
    among = common.written(placed.join(mixed, "key").join(hub_of, "key").select("rep", "key", "component", "hub", "hub_shared"), "among")
    # A class belongs to its component's blocks if that is large, else to those of its most central hub.
    members = common.written(among.groupBy("rep", "component").agg(F.max(F.struct("hub_shared", "hub")).alias("h")).select("rep", "component", F.col("h.hub").alias("anchor")), "members")
    large = members.groupBy("component").agg(F.count("*").alias("classes")).filter(F.col("classes") * 2 >= size)
    pool = common.written(members.join(large, "component", "left").withColumn("pool", F.when(F.col("classes").isNotNull(), F.concat(F.lit("c"), "component")).otherwise(F.concat(F.lit("h"), "anchor"))), "pool")
    pool = pool.join(own.select("rep", "n"), "rep")
    counts = pool.groupBy("pool").agg(F.ceil(F.greatest(F.count("*") / size, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt_by = F.when(F.col("classes").isNotNull(), F.col("rep")).otherwise(F.col("component"))
    blocks = common.written(pool.join(counts, "pool").select("rep", "component", F.concat_ws(":", "pool", F.pmod(F.xxhash64(dealt_by), F.col("blocks"))).alias("block")), "block-of")
    listed = among.select("rep", "key").join(blocks, "rep").groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    listed = common.written(listed, "listed")
    side = lambda x: listed.select("key", F.col("block").alias(f"block_{x}"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    met = side("a").join(side("b"), "key").filter("block_a <= block_b AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)").select("block_a", "block_b").distinct()
    met = common.written(met, "met")
    texts = rows.filter(F.col("id").isNotNull()).select(F.col("id").alias("rep"), "text")
    one_each = blocks.join(texts, "rep").dropDuplicates(["rep"]).join(own.select("rep", "keys", "prefix"), "rep")
    filled = one_each.groupBy("block").agg(F.collect_list(F.struct("rep", "component", "keys", "prefix", "text")).alias("members"))
    filled = common.written(filled, "blocks")
    half = lambda x: filled.select(F.col("block").alias(f"block_{x}"), F.struct("block", "members").alias(x))
    both = met.join(half("a"), "block_a").join(half("b"), "block_b").select("a", "b")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            found = [link for k in range(batch.num_rows) for link in _linked(batch.column("a")[k].as_py(), batch.column("b")[k].as_py(), percent, matches, cache)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    with common.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a row holds two blocks
        return common.written(both.mapInArrow(kernel, "a long, b long"), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """One row per row: ``id_col``, n_shingles, component_id, kept.

    Null text counts as empty. A document without words has no shingle, is its own component and stays. With fewer than
    five words the whole sequence is the only shingle. Repeated rows share a component; an id should not stand for different
    texts. Rows of null id join their class's component and are kept only if they have no component. An empty table gives
    no row. ``block`` bounds the classes that a task compares with so many others at once; the result does not depend on it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prepared = common.written(_prepared(rows), "signatures")
    classes = prepared.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("n", "signature")).alias("s"))
    classes = common.written(classes.filter("rep IS NOT NULL").select("digest", "rep", "s.n", "s.signature"), "classes")
    # Inverted lists: a key is a coordinate and its value.
    posted = classes.select("rep", "n", F.posexplode("signature").alias("coord", "value"))
    posted = posted.select("rep", "n", (F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    lists = common.written(posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "lists")
    own = posted.join(lists, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("list"), F.sum("df").alias("shared"))
    # Unshared values come first in the order, so they take places of the prefix.
    own = own.filter(F.size("list") >= matches).select("rep", "n", "shared", F.col("list.key").alias("keys"), F.expr(f"greatest(0, {COORDS - matches + 1} - ({COORDS} - size(list)))").alias("prefix"))
    own = common.written(own, "keys")
    prefixes = own.select("rep", "n", "shared", F.explode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("key"))
    central = prefixes.groupBy("key").agg(F.max(F.struct("shared", (-F.col("rep")).alias("r"))).alias("h")).select("key", (-F.col("h.r")).alias("hub"), F.col("h.shared").alias("hub_shared"))
    hub_of = common.written(central, "hubs")

    def counted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with at least ``matches`` equal coordinates and fitting sizes."""
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        found = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return common.written(found.select("a", "b", equal.alias("matches")).filter(F.col("matches") >= matches), "pairs").filter(F.col("matches") >= matches)

    hubs = counted(prefixes.join(hub_of, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    links = _confirmed(hubs.select("a", "b"), rows, percent)
    labels = components(links)
    labels = components(links.union(_between(own, prefixes, hub_of, labels, rows, percent, matches, block)))
    of_class = common.written(classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "members")
    found = prepared.select("id", "n", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
