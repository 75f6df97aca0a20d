"""What the corpus operators share: selecting inputs, sizing jobs and shared folders."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under internal names, so that other columns can have any name."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def volume(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def chunk_count(total_bytes: int, floor: int = 4 << 20, ceiling: int = 128 << 20) -> int:
    """How many chunks a corpus is dealt into. Chunks grow with the square root of the corpus, from `floor`
    to `ceiling` bytes, so that rows of the chunk-by-bucket exchange keep a useful length."""
    return max(1, math.ceil(total_bytes / min(ceiling, max(floor, 128 * math.isqrt(max(0, total_bytes))))))


def partitions(spark: SparkSession, total_bytes: int, each: int = 8 << 20) -> int:
    """Shuffle partitions for a volume: as many as configured, more if each would hold over `each` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is not set, a local session takes one of its own; a cluster must name one,
    as a machine's own folder is lost with the machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by writing a table to a fresh place in the shared folder and reading it again."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/quirefold-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Hot keys that may be broadcast: keys of over 1/10,000 of all rows, of which there can't be more than this.
HOT_KEYS = 10_000


def join_skewed(rows: DataFrame, one: DataFrame, key: str, weight: str, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """`rows` joined (inner or left) with a table of one row a key, whose column `weight` says how many of the `total` rows the key has.

    Hot keys are broadcast, so that their rows stay where they are; all others are joined by a shuffle, in which no key has
    more than max(least, total / HOT_KEYS) rows. Both inputs are read twice: they should be checkpointed or cheap.
    """
    limit = max(least, math.ceil(total / HOT_KEYS))
    hot = F.broadcast(one.where(F.col(weight) > limit).drop(weight))
    cold = one.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key).unionByName(rest)


def row_key(*cols: str) -> Column:
    """A 128-bit key of a row's contents: equal rows share it, other rows don't."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7919), *reversed(cols)).alias("b"))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds __row_key, the key of (id, text) that the operators use."""
    named = {"__id": F.col(f"`{id_col}`").cast("long"), "__text": F.col(f"`{text_col}`").cast("string")}
    return docs.withColumns(named).withColumn("__row_key", row_key("__id", "__text")).drop(*named)
