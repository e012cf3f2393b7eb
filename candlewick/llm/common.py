"""Column expressions and helpers that several corpus operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.session import shared_folder

#: The six ASCII blanks: space and code points 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: Runs of blanks as a Java regular expression.
BLANK_RUN = "[ \\t-\\r]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z lower-cased and every other character as it is.

    A text of ASCII characters alone takes the built-in function.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for an empty text."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def hash128(*columns: Column) -> Column:
    """Two 64-bit hashes as a struct: equal for equal values, and in practice only for those."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7919), *columns).alias("b"))


def stable_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on seed and parts alone, from 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def held_fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """``frame`` written, with ``options`` of the writer, to a new folder below ``spark.checkpoint.dir`` and read again.

    Files in the shared folder outlive the executors that wrote them, and the
    steps that follow start from them instead of computing the frame again.
    """
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
