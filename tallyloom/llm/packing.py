"""Sum-of-squares packing of documents into sequences of tokens.

N(g) counts the open sequences with g free places.  A piece goes where the sum of
N(g)**2 becomes smallest: from gap g to gap g - s, that sum changes by
1 - 2 N(g) + (1 + 2 N(g - s)), the last two terms only if the sequence stays open.
A sequence is opened when no open one has room.  Pieces are dealt by hash to shards
of bounded size, each packed by itself, longest pieces first; so a shard wastes a
few sequences among thousands, and no task sees more than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encoded, vocabulary
from tallyloom.llm.rows import buckets, checkpointed, doc_id, identified

CAPACITY = 4096
#: Stands after each document.
END_OF_DOCUMENT = 1
#: Pieces in a shard, about.
SHARD_PIECES = 20_000


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths from 1 to capacity, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # N(g) for 0 < g <= capacity
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        stays = 2 * count[: capacity - s + 1] + 1
        stays[0] = 0
        change = np.where(count[s:] > 0, 1 - 2 * count[s:] + stays, np.iinfo(np.int64).max)
        best = int(change.argmin())
        if change[best] == np.iinfo(np.int64).max:
            b, gap, n_bins = n_bins, capacity, n_bins + 1
        else:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def tokenized_pieces(docs: DataFrame, capacity: int, path: str | None) -> DataFrame:
    """A row for each piece of a document: _doc, _sub, piece, start, length, ids_crc32."""
    where = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_OF_DOCUMENT], "<u4").tobytes()
        for rows, all_ids in encoded(batches, where):
            out: list[list[int]] = [[], [], [], [], []]
            for r, ids in enumerate(all_ids):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(start + capacity, n)
                    for column, value in zip(out, (r, piece, start, stop - start, crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
            of = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["_doc", "_sub", "piece", "start", "length", "ids_crc32"])

    return identified(docs, "text").mapInArrow(run, "_doc long, _sub long, piece int, start long, length long, ids_crc32 long")


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("_doc", "ascending"), ("_sub", "ascending"), ("piece", "ascending")]
        table = table.sort_by(order)
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(key[0].as_py() * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the end mark; only one longer than a sequence is
    cut.  A null or empty text is the end mark alone.  Rows that share a doc_id are
    packed each for itself; no rows give no rows; columns but doc_id and text are ignored.
    """
    pieces = checkpointed(tokenized_pieces(docs, capacity, path))
    n_shards = buckets(pieces.count(), SHARD_PIECES)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("_doc", "_sub", "piece"), F.lit(n_shards)))
    packed = sharded.groupBy("shard").applyInArrow(_pack(capacity), "_doc long, _sub long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
