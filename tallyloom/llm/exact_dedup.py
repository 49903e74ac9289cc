"""Exact dedup against history: a minimal perfect hash over historical distinct digests.

The digests of documents already taken in are split by their leading bits into
shards of bounded size.  Each shard gets a minimal perfect hash by bucketed
displacement: keys are dealt to small buckets, largest bucket first, and each
bucket tries displacements until its keys fall on free slots.  A slot holds the
whole 32-byte digest, the locator of the document that stays and the number of
its copies.  New digests, pre-aggregated so that a text copied a billion times is
one row, are looked up in their shard; a hit counts only if all 32 bytes agree.
Digests that miss are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.rows import NO_ID, buckets, checkpointed, doc_id, identified, spread, whole_rows

#: Distinct digests in a shard: some megabytes of slots.
SHARD_KEYS = 32_768
#: Keys in a bucket of the hash, on average.
BUCKET_KEYS = 4
GROUPS = "digest binary, keep_id long, keep_sub long, group_size long"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A bijection of n distinct digests onto 0..n-1; any other digest gets some slot as well."""

    def __init__(self, displacements: np.ndarray, n: int):
        self.displacements, self.n = displacements, n

    @staticmethod
    def _bucket(words: np.ndarray, n_buckets: int) -> np.ndarray:
        return (words[:, 1] % np.uint64(n_buckets)).astype(np.int64)

    @staticmethod
    def _slot(words: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        return (_mix(words[:, 2] + _mix(words[:, 3] ^ displacement.astype(np.uint64))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, digests: list[bytes]) -> PerfectHash:
        n = len(digests)
        n_buckets = max(1, n // BUCKET_KEYS)
        words = _words(digests)
        bucket = cls._bucket(words, n_buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        firsts = np.cumsum(sizes) - sizes
        displacements = np.zeros(n_buckets, np.uint32)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if not size:
                break
            keys = words[order[firsts[b] : firsts[b] + size]]
            begin, tries = 0, 64
            while True:  # blocks of displacements at once; the last keys of a full table need about n tries
                d = np.repeat(np.arange(begin, begin + tries), size)
                slots = cls._slot(np.tile(keys, (tries, 1)), d, n).reshape(tries, size)
                good = ~taken[slots].any(axis=1)
                if size > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    at = int(good.argmax())
                    displacements[b] = begin + at
                    taken[slots[at]] = True
                    break
                begin, tries = begin + tries, min(8192, tries * 4)
        return cls(displacements, n)

    def slots(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, np.int64)
        words = _words(digests)
        return self._slot(words, self.displacements[self._bucket(words, len(self.displacements))], self.n)


def _build_shard(table: pa.Table) -> pa.Table:
    """One row for a shard: the displacements and, in slot order, digests, locators and counts."""
    digests = table["digest"].to_pylist()
    perfect = PerfectHash.build(digests)
    at = np.empty(len(digests), np.int64)
    at[perfect.slots(digests)] = np.arange(len(digests))
    column = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)[at].tobytes()
    return pa.table({
        "shard": table["shard"].slice(0, 1), "displacements": [perfect.displacements.tobytes()], "slots": [b"".join(digests[i] for i in at)],
        "ids": [column("keep_id")], "rows": [column("keep_sub")], "sizes": [column("group_size")],
    })


def _probe_shard(new: pa.Table, index: pa.Table) -> pa.Table:
    """All groups of a shard: history's with the copies that came since, then those of new digests alone."""
    digests = new["digest"].to_pylist()
    ids, rows, sizes = (new[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keep_id", "keep_sub", "group_size"))
    if not index.num_rows:
        return pa.table({"digest": pa.array(digests, pa.binary()), "keep_id": ids, "keep_sub": rows, "group_size": sizes})
    held = index["slots"][0].as_py()
    old_ids, old_rows, old_sizes = (np.frombuffer(index[c][0].as_py(), np.int64).copy() for c in ("ids", "rows", "sizes"))
    perfect = PerfectHash(np.frombuffer(index["displacements"][0].as_py(), np.uint32), len(old_ids))
    slots = perfect.slots(digests)
    hit = np.fromiter((held[32 * s : 32 * s + 32] == d for s, d in zip(slots.tolist(), digests, strict=True)), bool, len(digests))
    old_sizes[slots[hit]] += sizes[hit]
    fresh = [d for d, h in zip(digests, hit, strict=True) if not h]
    return pa.table({
        "digest": pa.array([held[i : i + 32] for i in range(0, len(held), 32)] + fresh, pa.binary()),
        "keep_id": np.concatenate([old_ids, ids[~hit]]), "keep_sub": np.concatenate([old_rows, rows[~hit]]), "group_size": np.concatenate([old_sizes, sizes[~hit]]),
    })


def digested(rows: DataFrame) -> DataFrame:
    """_doc, _sub and the SHA-256 digest of the normalised text of each row (_doc, _sub, text)."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    return checkpointed(rows.select("_doc", "_sub", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))


def _distinct(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct((F.col("_doc") == NO_ID).alias("no_id"), "_doc", "_sub"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("first._doc").alias("keep_id"), F.col("first._sub").alias("keep_sub"), "group_size")


def index_history(history: DataFrame, n_shards: int) -> DataFrame:
    """A row for each shard of the historical digests (digest, keep_id, keep_sub, group_size), all distinct."""
    return _sharded(history, n_shards).groupBy("shard").applyInArrow(_build_shard, "shard long, displacements binary, slots binary, ids binary, rows binary, sizes binary")


def _sharded(distinct: DataFrame, n_shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % n_shards)


def look_up(new: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Groups of history and of the new distinct digests together: digest, keep_id, keep_sub, group_size."""
    return _sharded(new, n_shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe_shard, GROUPS)


def grouped(numbered: DataFrame) -> DataFrame:
    """Every row (_doc, _sub, text) with the group of its text: _doc, _sub, digest, keep_id, keep_sub, group_size.

    Documents in the lower half of the range of doc_id are the history, the others
    are checked against it.
    """
    rows = digested(numbered)
    low, high, n = rows.filter(F.col("_doc") != NO_ID).agg(F.min("_doc"), F.max("_doc"), F.count(F.lit(1))).first()
    old = (F.col("_doc") != NO_ID) & (F.col("_doc") <= ((low or 0) + (high or 0)) // 2)
    n_shards = buckets(n, SHARD_KEYS)
    index = checkpointed(index_history(_distinct(rows.filter(old)), n_shards))
    return spread(rows, look_up(_distinct(rows.filter(~old)), index, n_shards), ["digest"], ["_doc", "_sub"])  # copies of one text may be a third of all rows


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after replacing each run of ASCII white
    space by one space; a null text is empty.  The row with the smallest doc_id stays,
    one of those that share it, a null id only where there is no other.  No rows give
    no rows; columns but doc_id and text are ignored.
    """
    kept = (F.col("_doc") == F.col("keep_id")) & (F.col("_sub") == F.col("keep_sub"))
    return grouped(identified(docs, "text")).select(doc_id(), F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay."""
    rows = whole_rows(docs)
    stay = grouped(rows).filter((F.col("_doc") == F.col("keep_id")) & (F.col("_sub") == F.col("keep_sub"))).select("_doc", "_sub")
    return rows.join(stay, ["_doc", "_sub"]).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
