"""What several of the operators share: checkpoints, size-checked broadcasts and word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.runtime import BROADCAST_ROWS, settle, small

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "among", "ascii_lower", "remainder", "settle", "sieve", "small", "table", "text_key", "words"]

#: ASCII white space, the separator of words in most contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def text_key(*columns: str) -> Column:
    """A key of a row's content, for tables in which a doc_id can repeat."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def remainder(doc_id: str, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(0))


#: Rows of the table of bits that stands for a table of keys; each holds 64.
BITS = 1 << 17


def sieve(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``df`` without most of the rows whose ``on`` is not in ``keys``; those whose ``on`` is in it all stay.

    Each key sets one of 64 * BITS bits by its hash, and the bits are broadcast as at most BITS numbers, whatever the number
    of keys. Of a million keys about one row in nine that isn't among them passes, of ten million two in three.
    """
    hash_ = F.xxhash64(on)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hash_.bitwiseAND(63).cast("int"))
    row = F.pmod(F.shiftright(hash_, 6), F.lit(BITS)).cast("int")
    bits = F.broadcast(keys.groupBy(row.alias("bits_row")).agg(F.bit_or(bit).alias("bits")))
    return df.join(bits, row == F.col("bits_row")).where(F.col("bits").bitwiseAND(bit) != 0).drop("bits_row", "bits")


def among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``keys`` (only ``on``, each once). Too many keys to be broadcast are met by a shuffle, before
    which ``sieve`` has dropped most of the other rows."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on, "left_semi")
    # a semi join would be pushed below the sieve
    return sieve(df, keys, on).join(keys, on)
