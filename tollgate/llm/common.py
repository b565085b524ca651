"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import gather, materialize, shared_dir

__all__ = ["buckets_for", "gather", "materialize", "parted", "passing", "read_table", "shared_dir", "small_batches"]

#: Texts that Spark sends to Python at once: 10,000, its default, hold tens of megabytes on either side.
BATCH = 500
#: Bits for each key of a filter, and bits of a filter at most (2 million words of 64). For more keys there is none.
KEY_BITS, MOST_BITS = 8, 27


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """What runs in here sends at most ``rows`` rows to Python at once, which bounds what a worker and its executor hold of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the registered queries."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """Number of buckets that keeps each near ``per_bucket`` rows, however many rows there are."""
    return max(least, -(-max(rows, 0) // per_bucket))


def _bit(key: str, bits: int) -> tuple[Column, Column]:
    """Word of 64 bits, and place in it, of a key's hash."""
    low = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(low, 6), low.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(held: DataFrame, key: str) -> tuple[DataFrame | None, Column, Column]:
    """Words (f_word, f_bits) of a bitmap of the hashes of ``held`` keys, or None; and a row's word and bit."""
    bits = max(15, (KEY_BITS * held.count()).bit_length())
    word, place = _bit(key, bits)
    if bits > MOST_BITS:
        return None, word, place
    words = held.select(word.alias("f_word"), place.alias("f_place")).groupBy("f_word").agg(F.bit_or(F.expr("shiftleft(1L, f_place)")).alias("f_bits"))
    return F.broadcast(words), word, F.call_function("getbit", F.col("f_bits"), place) == 1  # 2 million words at most


def passing(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be among the written ``held`` keys: all that are, and few others.

    A bitmap of hashes in words of 64 bits, broadcast, of ``KEY_BITS`` bits a key, so few bits are set
    whatever the input. Beyond 2^MOST_BITS bits all rows pass: what follows is a join, which needs no
    filter for its result.
    """
    words, word, on = _bitmap(held, key)
    return rows if words is None else rows.join(words, word == F.col("f_word")).where(on).drop("f_word", "f_bits")


def parted(rows: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``passing`` rows, and all others, none of which has a key of ``held``."""
    words, word, on = _bitmap(held, key)
    if words is None:
        return rows, rows.limit(0)
    marked = rows.join(words, word == F.col("f_word"), "left").withColumn("f_on", F.coalesce(on, F.lit(False))).drop("f_word", "f_bits")
    return marked.where("f_on").drop("f_on"), marked.where("not f_on").drop("f_on")
