"""Row identity, checkpoints and sizes shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands in for a null doc_id, so that such rows are ordered first and joined like others.
NO_ID = -(1 << 63)


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the folder that the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))  # in local mode one process has all
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, and without the size that the planner has estimated for it.

    A checkpoint keeps its plan's estimate, and a join's is the product of both sides':
    in a loop of joins the estimates' digits double from one checkpoint to the next,
    until the planner does nothing but multiply them.
    """
    kept = checkpointed(df)
    session = kept.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), session)


def freed(df: DataFrame) -> None:
    """Lets Spark remove the shuffle and checkpoint files of steps that are done.

    It does so as the driver's collectors find their frames out of reach.  A driver
    with little to do collects every half hour alone, by which time an operator of
    many short steps holds the files of all of them.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Parts of a group of rows that share their doc_id and text, while they are numbered.
_PARTS = 1024


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """_doc (doc_id, a null one as NO_ID), _sub and the named columns.

    _doc and _sub name a row: _sub is 0 but for rows that share their doc_id, which
    are numbered in the order of a hash of their texts; rows that share the text as
    well are told apart in no stated order.  Only the ids are read to find out, and no
    task gets all rows that share an id.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"))
    again = ids.groupBy("_doc").count().filter("count > 1").limit(1).count() > 0
    out = docs.select(ids_column().alias("_doc"), *columns)
    if again:
        from pyspark.sql import Window

        name = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if "text" in columns else F.lit(0).cast("long"), 36)
        named = checkpointed(out.withColumn("_name", name).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(_PARTS))))
        nth = F.row_number().over(Window.partitionBy("_doc", "_name", "_part").orderBy(F.lit(0))) - 1
        out = checkpointed(named.withColumn("_sub", F.shiftleft("_name", 35) + nth * _PARTS + F.col("_part")))
    else:
        out = out.withColumn("_sub", F.lit(0).cast("long"))
    return out.select("_doc", "_sub", *columns)


def whole_rows(docs: DataFrame) -> DataFrame:
    """_doc, _sub, text and _row (all columns of docs) of every row, numbered once, so that decisions about rows can be joined back to them."""
    return identified(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "text", "_row")


def ids_column() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def doc_id() -> Column:
    """The doc_id that _doc stands for."""
    return F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id")


def buckets(n_rows: int, each: int) -> int:
    """How many hash buckets hold about `each` rows."""
    return max(1, math.ceil(n_rows / each))


#: Bytes of text that count as a document, where documents are longer on average.
DOCUMENT_BYTES = 4096


def volume(docs: DataFrame) -> int:
    """The number of rows, or of stretches of 4 KB of text if these are more."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(rows, math.ceil(size / DOCUMENT_BYTES))


def dealt_among(size: int, each: int) -> int:
    """How many groups to deal a volume to where each group sends a row to each of another kind.

    Groups hold `each` at least and grow with the root of the volume, so the rows sent
    grow in proportion to it: at a hundred million documents, a group is of 10,000.
    """
    return buckets(size, max(each, math.isqrt(size)))


#: Parts that rows with one key are spread over.
SPREAD = 64


def spread(rows: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with few (a handful of rows for a key) on keys, where very many of `rows` may share a key.

    Rows are spread by a hash of `by`; what a key has in `few` goes once to each part
    of the key that there is, so no task gets all rows of a key.
    """
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(SPREAD)))
    return parted.join(parted.select(*keys, "_part").distinct().join(few, keys), [*keys, "_part"]).drop("_part")
