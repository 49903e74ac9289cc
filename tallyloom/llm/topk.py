"""Exact top-k search by inner product, in buckets of vectors of like length.

Candidates are grouped by length, in buckets a twentieth apart, and a bucket into
blocks of bounded size.  One block of the longest vectors gives each query a first
threshold: its k-th best score there.  A bucket whose longest vector is l can only
help a query q whose local cosine threshold, threshold / (|q| l), is at most 1; other
blocks are not even sent the query.  In a block, a high local threshold bounds the
candidate's place on the query's largest coordinate (coordinate pruning), a low one
only its length (length pruning).  What is left is verified by whole products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.rows import buckets, checkpointed

#: Candidates in a block and queries in a block, about.
BLOCK, QUERIES = 1024, 1024
#: Lengths in a bucket differ by this factor at most.
RATIO = 1.05
#: Local cosine threshold from which coordinates are looked at.
COORDINATES = 0.6
#: Room for rounding in bounds; products themselves are exact.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long"


def quantized(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (whole numbers floor(scale * x)) and length of each vector whose components are all finite."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    good = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    return whole.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(lists), width), np.int64)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, held to 64 bits."""
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(float) @ candidates.T.astype(float)).astype(np.int64)
    return np.clip(queries.astype(object) @ candidates.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def kept(query: np.ndarray, length: float, threshold: float, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which candidates may reach the threshold: by a coordinate where the local threshold is high, else by length."""
    if threshold <= 0 or not len(lengths):
        return np.ones(len(lengths), bool)
    if length == 0:
        return np.zeros(len(lengths), bool)
    local = threshold / (length * float(lengths.max()) * (1 + SLACK) + 1e-300)
    if local > 1:
        return np.zeros(len(lengths), bool)
    if local < COORDINATES:
        return lengths * length * (1 + SLACK) >= threshold
    f = int(np.abs(query).argmax())
    between, apart = np.arccos(np.clip(query[f] / length, -1, 1)), np.arccos(local)
    least, most = np.cos(min(np.pi, between + apart)), np.cos(max(0.0, between - apart))
    return (unit[:, f] >= least - 1e-7) & (unit[:, f] <= most + 1e-7)


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best of the block for each query, without those below its threshold."""
    out = []
    lengths = np.sqrt((block.astype(float) ** 2).sum(axis=1))
    unit = block / np.maximum(lengths, 1e-300)[:, None]
    own = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    for lo in range(0, len(query_ids), 64):
        some = slice(lo, lo + 64)
        keep = np.array([kept(q, n, t, unit, lengths) for q, n, t in zip(queries[some], own[some], thresholds[some], strict=True)])
        any_of = np.flatnonzero(keep.any(axis=0))
        if not len(any_of):
            continue
        scores = products(queries[some], block[any_of])
        for q, mine, line, t in zip(query_ids[some].tolist(), keep[:, any_of], scores, thresholds[some], strict=True):
            mine = np.flatnonzero(mine & (ids[any_of] != q) & (line >= t))
            order = mine[np.lexsort((ids[any_of][mine], -line[mine]))[:k]]
            out += [(q, i, s) for i, s in zip(ids[any_of][order].tolist(), line[order].tolist(), strict=True)]
    return out


def _found(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _search(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return _found([])
        q, c = queries["v"].to_pylist(), block["v"].to_pylist()
        width = max(1, *map(len, q), *map(len, c))
        thresholds = queries["threshold"].to_numpy()
        return _found(best_in_block(queries["vec_id"].to_numpy(), _matrix(q, width), thresholds, block["vec_id"].to_numpy(), _matrix(c, width), k))

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner products for each query.

    Both inputs have vec_id, v and length, as `quantized` gives them.  Blocks of queries
    meet blocks of candidates; a block answers with k rows a query at most, none of them
    below what the query has already.  Ties go to the smaller vec_id.  A vector isn't
    its own neighbour, nor is any with its vec_id.  Vectors of several widths are
    compared as if the shorter ones ended in zeros.  No rows give no rows.
    """
    vectors = checkpointed(vectors.withColumn("bucket", F.floor(F.log(F.col("length") + 1) / F.log(F.lit(RATIO)))))
    sizes = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("length").alias("top")).orderBy(F.desc("bucket")).collect()  # of the range of lengths, not of rows
    first, table = 0, []
    for row in sizes:
        n = buckets(row["size"], BLOCK)
        table.append((row["bucket"], first, n, row["top"]))
        first += n
    if not first:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).filter("false")
    spark = vectors.sparkSession
    plan = spark.createDataFrame(table, "bucket long, first long, n long, top double")
    blocks = vectors.join(F.broadcast(plan.drop("top")), "bucket").select("vec_id", "v", "bucket", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "n")).alias("block"))
    asked = queries.select(*(F.col(c).alias(c) for c in ("vec_id", "v", "length")))

    q_blocks = buckets(queries.count(), QUERIES)
    start = blocks.filter("block = 0").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))  # the longest vectors
    began = asked.withColumn("threshold", F.lit(float("-inf"))).withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)))
    known = checkpointed(_ranked(began.groupBy("q_block").cogroup(start.groupBy("q_block")).applyInArrow(_search(k), FOUND), k))
    thresholds = known.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("threshold"))

    # a query only helps itself to buckets whose longest vector reaches its need; queries of like need share a block
    need = F.when(F.col("threshold") <= 0, 0.0).when(F.col("length") > 0, F.col("threshold") / (F.col("length") * (1 + SLACK))).otherwise(float("inf"))
    needs = asked.join(thresholds, "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf")))).withColumn("need", need)
    tops = [row["top"] for row in sizes]  # descending
    reach = F.size(F.filter(F.array(*(F.lit(t) for t in tops)), lambda t: t >= F.col("need")))  # so many buckets, the longest first
    needs = checkpointed(needs.withColumn("reach", reach))
    counts = {row["reach"]: row["count"] for row in needs.groupBy("reach").count().collect()}  # a row for a bucket at most
    groups, q_first, places = _together(counts), 0, []
    for reaches, size in groups:
        n = buckets(size, QUERIES)
        places += [(r, q_first, n, max(reaches)) for r in reaches]
        q_first += n
    ends = [row[1] + row[2] for row in table]  # blocks of the buckets up to each
    spots = spark.createDataFrame([(r, f, n, ends[g - 1] - 1 if g else 0) for r, f, n, g in places], "reach int, q_first long, q_n long, last long")
    q = needs.join(F.broadcast(spots), "reach").withColumn("q_block", F.col("q_first") + F.pmod(F.xxhash64("vec_id"), "q_n"))
    sent = q.filter("last > 0").select("vec_id", "v", "threshold", "q_block", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("block"))
    # the blocks of queries that reach a bucket are those from some number on, as groups come in order of reach
    from_block = [(table[i][0], min([f for r, f, _, g in places if g > i], default=q_first)) for i in range(len(table))]
    begins = spark.createDataFrame(from_block, "bucket long, q_from long")
    there = blocks.filter("block > 0").join(F.broadcast(begins), "bucket").filter(F.col("q_from") < q_first).withColumn("q_block", F.explode(F.sequence("q_from", F.lit(q_first - 1).cast("long")))).drop("bucket", "q_from")
    found = sent.groupBy("block", "q_block").cogroup(there.groupBy("block", "q_block")).applyInArrow(_search(k), FOUND)
    return _ranked(known.drop("rank").unionByName(found), k).select("query_id", "rank", "vec_id", "score")


def _together(counts: dict[int, int]) -> list[tuple[list[int], int]]:
    """Neighbouring reaches, ascending, gathered until a group has a block's queries."""
    out: list[tuple[list[int], int]] = []
    for reach in sorted(counts):
        if out and out[-1][1] < QUERIES:
            out[-1] = ([*out[-1][0], reach], out[-1][1] + counts[reach])
        else:
            out.append(([reach], counts[reach]))
    return out


def query_topk(embeddings: DataFrame, each: int = 100, k: int = 10) -> DataFrame:
    """topk of the rows whose vec_id is divisible by `each`, against all rows.

    Vectors that are null or hold null or non-finite components take no part.  Of
    queries that share a vec_id, the smallest vector asks; other columns are ignored.
    """
    vectors = quantized(embeddings)
    queries = vectors.filter(F.col("vec_id") % each == 0).groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("q")).select("vec_id", "q.v", "q.length")
    return topk(vectors, checkpointed(queries), k)
