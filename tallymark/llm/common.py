"""Helpers shared by the training-data operators: reading tables, shared-folder tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table with at most this many rows, each of bounded width, may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: A table whose texts and lists may be of any length is broadcast only if they are no more than this in all, too.
BROADCAST_BYTES = 128 << 20
#: No more keys than this hold so large a share of a join's rows that they are broadcast, by `spread`.
HOT_KEYS = 100_000
#: Bytes of rows that a Python worker gets at once. Spark's own bound is 10,000 rows, of whatever length.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="tallymark-")
        _own[app] = found
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit; as it is otherwise."""
    return F.broadcast(df) if rows <= limit else df


def light(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its rows, by one aggregation, are within the limit and their bytes as JSON within BROADCAST_BYTES."""
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, width = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and width <= BROADCAST_BYTES else df


def spread(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and, as `n`, how many of the `total` rows hold it; n is dropped.

    The keys of over 64 rows and of over a HOT_KEYS-th of all are fewer than HOT_KEYS, whatever the data, and are broadcast,
    so that the rows of such a key stay where they are. The others are shuffled.
    """
    bar = max(64, -(-total // HOT_KEYS))
    hot, other = (table.filter(c).drop("n") for c in (F.col("n") > bar, F.col("n") <= bar))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def in_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow over batches that end at BATCH_BYTES, so that workers and the JVM's buffers don't grow with the texts.

    The bound is a setting of the session, as the result is computed later; one that the session has stands.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte per character take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Counts at which a table of counts may be cut into its frequent and its other rows: half octaves.
CUTS = [2, 3, *(int(2 ** (k / 2)) for k in range(4, 120))]


def cut_for(counted: DataFrame, count: str, rows: int) -> int:
    """The least of CUTS that at most `rows` rows of a table reach, by one aggregation."""
    sums = counted.agg(*[F.count_if(F.col(count) >= c).alias(f"k{k}") for k, c in enumerate(CUTS)]).first()
    return next((c for k, c in enumerate(CUTS) if sums[f"k{k}"] <= rows), 1 << 62)
