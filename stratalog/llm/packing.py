"""Bounded-space online packing of token ids into sequences.

A partition keeps a fixed number of open windows. A document's full windows leave at once. Its rest goes to the window that
it fills best; if it fits none, the fullest window is closed with the head of that rest (so it leaves without padding) and a
new window takes what remains. At the end the open windows are merged: their ids are laid end to end and cut at the window's
length, and the last remainder at powers of two, which need no padding either.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.tokens import encoder

LENGTH, OPEN_WINDOWS = 4096, 64

#: A piece: document (place in the batch order), start, ids.
Piece = tuple[tuple, int, np.ndarray]


class Packer:
    """Takes documents one by one; ``sequences`` gets closed ones as lists of pieces."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.length, self.most = length, windows
        self.open: list[tuple[int, int]] = []  # (free ids, number), in order
        self.held: dict[int, list[Piece]] = {}
        self.made = 0
        self.sequences: list[list[Piece]] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.sequences.append([(doc, at, ids[at : at + self.length])])
        rest, at = ids[whole:], whole
        if not len(rest):
            return
        best = bisect_right(self.open, (len(rest), -1))
        if best == len(self.open) and len(self.open) == self.most:
            free, number = self.open.pop(0)
            self.sequences.append([*self.held.pop(number), (doc, at, rest[:free])])
            rest, at = rest[free:], at + free
            best = len(self.open)
        if best < len(self.open):
            free, number = self.open.pop(best)
        else:
            free, number = self.length, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((doc, at, rest))
        if free > len(rest):
            insort(self.open, (free - len(rest), number))
        else:
            self.sequences.append(self.held.pop(number))

    def finish(self) -> None:
        """Merge what is still open."""
        rest = deque(p for _, number in self.open for p in self.held[number])
        left = sum(len(p[2]) for p in rest)
        self.open, self.held = [], {}
        while left:
            goal = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= goal
            taken: list[Piece] = []
            while goal:
                doc, at, ids = rest.popleft()
                if len(ids) > goal:
                    rest.appendleft((doc, at + goal, ids[goal:]))
                    ids = ids[:goal]
                taken.append((doc, at, ids))
                goal -= len(ids)
            self.sequences.append(taken)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the token ids.

    Null text counts as empty and still has its end id. Rows with repeated or null ids are packed like others. Each
    partition of the input is packed by itself, so no rows move; an empty table gives no row. ``sequence_id`` is the
    partition times 2^32 plus a running number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common.small_batches(docs.sparkSession)

    def out(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
        flat = [(first + k, p) for k, s in enumerate(sequences) for p in s]
        sizes = np.array([len(p[2]) for _, p in flat], np.int64)
        numbers = np.array([k for k, _ in flat], np.int64)
        ends = np.cumsum(sizes)
        new = np.append(True, numbers[1:] != numbers[:-1])
        begun = (ends - sizes)[np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
        data = {
            "doc_id": pa.array([p[0][0] for _, p in flat], pa.int64()), "start": pa.array([p[1] for _, p in flat], pa.int64()), "length": pa.array(sizes),
            "ids_crc32": pa.array([common.crc(p[2].astype("<u4").tobytes()) for _, p in flat], pa.int64()), "doc_tokens": pa.array([p[0][1] for _, p in flat], pa.int64()),
            "sequence_id": pa.array(numbers), "offset": pa.array(ends - sizes - begun),
        }
        return pa.RecordBatch.from_pydict(data | ({"ids": pa.array([p[2].astype(np.int32) for _, p in flat], pa.list_(pa.int32()))} if ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(length, windows), TaskContext.get().partitionId() << 32
        for piece in common.pieces(batches, "text", 3 << 20):
            all_ids, bounds = encoder(tokenizer).encode(piece.column("text"))
            for k, name in enumerate(piece.column("id").to_pylist()):
                own = all_ids[bounds[k] : bounds[k + 1]]
                packer.add((name, len(own)), own)
            # What stays open is copied, so that it does not hold the batch's ids.
            packer.held = {w: [(d, a, x if x.base is None else x.copy()) for d, a, x in p] for w, p in packer.held.items()}
            if packer.sequences:
                yield out(packer.sequences, number)
                number += len(packer.sequences)
                packer.sequences = []
        packer.finish()
        if packer.sequences:
            yield out(packer.sequences, number)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * ids)
