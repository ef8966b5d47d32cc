"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its own partition as they stream by.  A level array counts
the open windows at each fill.  A document goes to the level that makes the sum of squared
counts smallest afterwards (its new fill gains a window, its old one loses one; a new window
opens at level zero), the fullest among equals.  Documents longer than a window are cut, and
only the last part is placed.  When a partition ends, the emptiest open windows are cut to
fill the gaps of the fullest, and what is left is cut into powers of two, which need no padding.

The packer is map-only: no shuffle, and no state beyond one partition's open windows.  Its
choices depend only on the partition's rows in their order, so a lost task is repeated with
the same result.  Sequence ids are the partition's number times 2**32 plus a counter.

Null and empty texts are one end token; every repeated row is packed for itself; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import arrow_type, text_slices

WINDOW = 2048
END_ID = 1


class Packer:
    """Open windows of one partition. A piece is [doc row, start, ids as bytes]."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill; ends stay zero
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level(self, size: int) -> int:
        """The fill to add ``size`` to: least sum of squared counts, the fullest among equals."""
        n = self.counts
        before = n[: self.window + 1 - size]
        # twice (count it joins - count it leaves), plus 2 for moving a window, or 1 for closing or opening one
        cost = 2 * (n[size:] - before) + 2
        cost[-1] -= 1
        open_cost = 2 * n[size] + 1
        cost[before == 0] = np.iinfo(np.int64).max
        cost[0] = open_cost
        return len(cost) - 1 - int(cost[::-1].argmin())

    def add(self, piece) -> list | None:
        """Place a piece shorter than a window; the window's pieces if that fills it."""
        size = len(piece[2]) // 4
        at = self.level(size)
        if at:
            pieces = self.open[at].pop()
            self.counts[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + size == self.window:
            return pieces
        self.open[at + size].append(pieces)
        self.counts[at + size] += 1
        return None

    def close(self):
        """The windows still open, their gaps filled by cutting the emptiest ones."""
        rest = []
        for fill in range(self.window - 1, 0, -1):
            if fill & (fill - 1) == 0:
                yield from self.open[fill]
            else:
                rest += [[fill, pieces] for pieces in self.open[fill]]
        low, high, spare = 0, len(rest) - 1, []
        while low < high or (low == high and spare):
            fill, pieces = rest[low]
            while fill < self.window and (spare or low < high):
                if not spare:
                    spare = rest[high][1]
                    high -= 1
                doc, start, ids = spare.pop()
                room = 4 * (self.window - fill)
                pieces.append([doc, start, ids[:room]])
                if len(ids) > room:
                    spare.append([doc, start + room // 4, ids[room:]])
                fill += min(room, len(ids)) // 4
            rest[low][0] = fill
            if fill < self.window:
                break
            yield pieces
            low += 1
        last = (rest[low][1] if low <= high else []) + spare
        size = sum(len(p[2]) for p in last) // 4
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if size >> bit & 1:
                room, pieces = 4 << bit, []
                while room:
                    doc, start, ids = last.pop()
                    pieces.append([doc, start, ids[:room]])
                    if len(ids) > room:
                        last.append([doc, start + room // 4, ids[room:]])
                    room -= min(room, len(ids))
                yield pieces


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: its document and place there, its sequence and place there, its ids' crc (and ids)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = array("I", [end_id]).tobytes()

    columns = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long"] + ["ids array<int>"] * keep_ids
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *columns])

    def run(batches):
        enc, packer, number = encoder(path), Packer(window), TaskContext.get().partitionId() << 32
        rows: list[list] = []

        def emit(pieces):
            nonlocal number
            at = 0
            for (doc, total), start, ids in pieces:
                n = len(ids) // 4
                rows.append([doc, start, n, zlib.crc32(ids), total, number, at] + [array("I", ids)] * keep_ids)
                at += n
            number += 1

        def frame(id_type):
            made = list(zip(*rows))
            rows.clear()
            types = [id_type, *map(arrow_type, columns)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types)], ["doc_id", *(c.split()[0] for c in columns)])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for first, texts in text_slices(batch.column(1)):
                docs = batch.column(0).slice(first, len(texts)).to_pylist()
                for name, got in zip(docs, enc.encode_batch(texts)):
                    got += end
                    total = len(got) // 4
                    doc = (name, total)
                    whole = total - total % window
                    for start in range(0, whole, window):
                        emit([[doc, start, got[4 * start : 4 * (start + window)]]])
                    if whole < total:
                        full = packer.add([doc, whole, got[4 * whole :]])
                        if full:
                            emit(full)
                if rows:
                    yield frame(id_type)
        for pieces in packer.close():
            emit(pieces)
        if rows:
            yield frame(id_type)

    return source.mapInArrow(run, schema)
