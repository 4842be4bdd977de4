"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.sources.scratch import shared_dir, stored

__all__ = ["MAX_LONG", "PARTS", "crc_of_id", "cut", "held_out", "join_counted", "read", "removed", "shared_dir", "stored"]

MAX_LONG = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one of so many rows is dealt over several tasks.
PARTS = 4096


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], parts: int = PARTS) -> DataFrame:
    """rows joined with counted on keys; counted has one row for each key, and `n`, the number of its rows.

    A key of very many rows is dealt over as many tasks as its share asks for, by
    a hash of `spread`, and its one row of counted goes to all of them. Fewer
    than `parts` keys can have more than one of `parts` rows, so the list of these
    is broadcast, however large the input.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    share = -(-total // parts) or 1
    hot = counted.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    sent = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / share), F.lit(1)).cast("int") - 1))).drop("n")
    return dealt.join(sent, [*keys, "_part"]).drop("_part")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return crc_of_id(doc_id) % modulus == remainder
