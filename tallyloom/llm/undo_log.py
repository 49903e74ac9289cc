"""Transactions from a log: persistent cons lists of changes, undone and published in pieces.

A log row is a change (`put`, `delete`), a `savepoint`, a `rollback`, a `commit` or an
`abort` of its stream.  The changes that a transaction still has are a cons list: a
change is a cell in front of the list before it, a savepoint stores the list's head, a
rollback walks from the head to the saved one and emits what it passes, a commit
publishes the chain, an abort walks all of it.

No stream is replayed in one task, as one may hold a third of the log.  A stream is cut
into blocks of BLOCK places of the log, which are replayed by themselves: the list that
a block starts on is an unknown tail.  A block tells the cells whose fate it knows, the
cells it leaves on the list, apart in those since its last savepoint and those before,
and the first control row of each kind that it has, which decides over older cells:
cells since the last savepoint go by the next control row of the stream, all others by
the next commit or abort.  The next ones are minima over later blocks (`ordered`), so
older cells are settled by a join.

Commits are numbered over the whole log by the same sums over blocks, and dealt to
epochs.  Published changes are then replayed by key: the last of a key in an epoch is
its version there, found by a grouping that combines before its shuffle, so that a key
with a third of all changes is one row an epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.llm.ordered import preceding
from tallyloom.llm.rows import parts, settled

#: Bits of a block's places: 1,024 of them.
BLOCK_BITS = 10
#: Commits in an epoch.
EPOCH_COMMITS = 64

CHANGES = ("put", "delete")


class _Block:
    """The replay of one block: a cell is (place in the block, the list after it); OLDER stands for the list before the block."""

    OLDER = None

    def __init__(self):
        self.head = self.saved = self.OLDER
        self.fates: list[tuple[int, str, int | None]] = []
        self.first: tuple[int, str] | None = None
        self.first_end: tuple[int, str] | None = None

    def emit(self, until, fate: str, by: int | None) -> None:
        """Walks from the head to the list `until` and tells what becomes of the cells passed."""
        while self.head is not until:
            place, self.head = self.head
            self.fates.append((place, fate, by))

    def row(self, place: int, seq: int, op: str) -> None:
        if op in CHANGES:
            self.head = (place, self.head)
            return
        self.first = self.first or (seq, op)
        if op == "savepoint":
            self.saved = self.head
        elif op == "rollback":
            self.emit(self.saved, "rollback", seq)
        else:
            self.first_end = self.first_end or (seq, op)
            self.emit(self.OLDER, op, seq)
            self.saved = self.OLDER

    def close(self) -> None:
        """What is left on the list goes by what comes later."""
        self.emit(self.saved, "loose", None)
        self.emit(self.OLDER, "held", None)


def _replay(types: pa.Schema):
    """A run over rows sorted by stream, block and seq: rows of kind cell, commit and block."""
    columns = ["kind", "stream", "block", "seq", "op", "key", "value", "fate", "by", "next", "end"]
    control = pa.struct([("seq", pa.int64()), ("op", pa.string())])

    def told(stream: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
        own = _Block()
        for place, (seq, op, _, _) in enumerate(rows):
            own.row(place, seq, op)
        own.close()
        pair = lambda x: x and {"seq": x[0], "op": x[1]}
        out = [("cell", stream, block, *rows[place], fate, by, None, None) for place, fate, by in own.fates]
        out += [("commit", stream, block, seq, op, None, None, None, None, None, None) for seq, op, _, _ in rows if op == "commit"]
        out.append(("block", stream, block, None, None, None, None, None, None, pair(own.first), pair(own.first_end)))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), types.field("key").type, types.field("value").type, pa.string(), pa.int64(), control, control]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((r for b in batches for r in zip(*(b[c].to_pylist() for c in ("stream", "block", "seq", "op", "key", "value")), strict=True)))
        for (stream, block), rows in groupby(each, key=lambda r: r[:2]):
            yield told(stream, block, [r[2:] for r in rows])

    return run


def replayed(log: DataFrame) -> DataFrame:
    """The replay of log (seq, stream, op, key, value) in blocks, settled: rows of kind cell, commit and block.

    A stream is named by a string, null is one as well.  Rows that share a seq are one
    row that was delivered again: the largest counts (nulls are smallest).  Rows without a
    seq have no place in the log and are left out.
    """
    named = log.filter(F.col("seq").isNotNull()).select("seq", F.struct(F.when(F.col("stream").isNull(), "-").otherwise(F.concat(F.lit("+"), "stream")).alias("stream"), "op", "key", "value").alias("r"))
    once = named.groupBy("seq").agg(F.max("r").alias("r")).select("seq", "r.*")
    blocked = once.withColumn("block", F.shiftright("seq", BLOCK_BITS)).select("stream", "block", "seq", "op", "key", "value")
    dealt = blocked.repartition(parts(log), "stream", "block").sortWithinPartitions("stream", "block", "seq")
    key, value = (blocked.schema[c].dataType.simpleString() for c in ("key", "value"))
    control = "struct<seq: bigint, op: string>"
    schema = f"kind string, stream string, block long, seq long, op string, key {key}, value {value}, fate string, by long, next {control}, end {control}"
    return settled(dealt.mapInArrow(_replay(_arrow(blocked.schema)), schema))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def changes(steps: DataFrame) -> DataFrame:
    """seq, stream, op, key, value, fate and by of every change: fate is commit, abort or rollback, by the row that decided (null: the log's end)."""
    at_block = steps.filter("kind = 'block'").select("stream", F.col("block"), (-F.col("block")).alias("back"), "next", "end")
    later = preceding(at_block, ["stream"], "back", next="min", end="min").select("stream", "block", "next_before", "end_before")
    cell = steps.filter("kind = 'cell'").select("seq", "stream", "block", "op", "key", "value", "fate", "by")
    known = cell.filter(F.col("by").isNotNull()).drop("block")
    left = cell.filter(F.col("by").isNull()).join(later, ["stream", "block"])
    back = (F.col("fate") == "loose") & (F.coalesce(F.col("next_before.op"), F.lit("")) == "rollback")
    fate = F.when(back, F.lit("rollback")).otherwise(F.coalesce("end_before.op", F.lit("abort")))
    by = F.when(back, F.col("next_before.seq")).otherwise(F.col("end_before.seq"))
    settled_later = left.withColumns({"fate": fate, "by": by}).select(known.columns)
    return known.unionByName(settled_later).withColumn("stream", F.when(F.col("stream") != "-", F.col("stream").substr(F.lit(2), F.length("stream"))))


def commits(steps: DataFrame) -> DataFrame:
    """by (the commit's seq) and epoch, from 1, of every commit."""
    one = steps.filter("kind = 'commit'").select("seq", F.lit(1).cast("long").alias("n"))
    return preceding(one, [], "seq", n="sum").select(F.col("seq").alias("by"), (F.floor(F.col("n_before") / EPOCH_COMMITS) + 1).cast("long").alias("epoch"))


def versions(changed: DataFrame, epochs: DataFrame) -> DataFrame:
    """key, epoch, live and value of the last published change of each key in each epoch, and live_before and value_before, those of its version before."""
    published = changed.filter("fate = 'commit'").join(epochs, "by")
    last = published.groupBy("key", "epoch").agg(F.max(F.struct("by", "seq", (F.col("op") == "put").alias("live"), "value")).alias("v"))
    version = settled(last.select("key", "epoch", F.struct("epoch", "v.live", "v.value").alias("held")))
    held = preceding(version.filter(F.col("key").isNotNull()), ["key"], "epoch", held="max")
    return held.select("key", "epoch", "held.live", "held.value", F.coalesce("held_before.live", F.lit(False)).alias("live_before"), F.col("held_before.value").alias("value_before"))


def states(version: DataFrame, epochs: DataFrame, measure: Column, before: Column) -> DataFrame:
    """epoch, stored and total after each epoch: the number of stored keys and the sum of measure (of a version; before: of the one it follows)."""
    counted = lambda live, what: F.sum(F.when(F.col(live), what).otherwise(0))
    moved = version.groupBy("epoch").agg((counted("live", 1) - counted("live_before", 1)).alias("stored"), (counted("live", measure) - counted("live_before", before)).alias("total"))
    each = epochs.select("epoch").distinct().join(moved, "epoch", "left").select("epoch", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("stored", "total")))
    summed = preceding(settled(each), [], "epoch", stored="sum", total="sum")
    return summed.select("epoch", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("stored", "total")))


#: What remainders by 17 of a record's checksum mean; all others are changes.
_OPS = {"commit": (0, 1), "abort": (2,), "savepoint": (3, 4), "rollback": (5, 6)}
KEYS = 30_000


def document_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs as a log: seq (doc_id), stream (source), op, key, and value, the checksum of `key:text`, so that no text is shuffled."""
    toxic = labels.filter((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("seq")).distinct().withColumn("toxic", F.lit(True))
    h = F.crc32(F.col("doc_id").cast("string"))
    op = F.lit("put")
    for name, remainders in _OPS.items():
        op = F.when((h % 17).isin(*remainders), F.lit(name)).otherwise(op)
    key = F.floor(h / 100) % KEYS
    record = docs.select(F.col("doc_id").cast("long").alias("seq"), F.col("source").cast("string").alias("stream"), op.alias("op"), F.when(h % 17 > 6, key).alias("key"), F.when(h % 17 > 6, F.crc32(F.concat(key.cast("string"), F.lit(":"), "text"))).alias("value"))
    told = record.join(toxic, "seq", "left")
    gone = (F.col("op") == "put") & (F.col("value").isNull() | F.coalesce("toxic", F.lit(False)))
    return told.select("seq", "stream", F.when(gone, "delete").otherwise(F.col("op")).alias("op"), "key", F.when(~gone, F.col("value")).alias("value"))


def transaction_log(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, id, n, value: a `state` row after each epoch, and an `abort` or `rollback` row for each change undone.

    state: the epoch's number, the count of stored keys, the sum of their checksums.
    abort, rollback: the change's doc_id, that of the row that undid it (null: the log's
    end), its key.  A null source is a stream of its own; a null text or a toxic label
    deletes the key; rows that share a doc_id are one record, delivered again (the
    largest checksum counts); rows without a doc_id have no place in the log; labels that
    are null or belong to no document say nothing.  Without commits there is no state; no
    rows give no rows; columns but doc_id, text and source are ignored.
    """
    steps = replayed(document_log(docs, labels))
    changed, epochs = settled(changes(steps)), settled(commits(steps))
    state = states(versions(changed, epochs), epochs, F.col("value"), F.col("value_before"))
    undone = changed.filter("fate <> 'commit'").select(F.col("fate").alias("kind"), F.col("seq").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return state.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("stored").alias("n"), F.col("total").alias("value")).unionByName(undone)
