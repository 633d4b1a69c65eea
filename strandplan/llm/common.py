"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandplan.lineage import materialise, shared_folder

__all__ = ["ascii_words", "commonest", "lower_ascii", "materialise", "own_name", "repeat_rows", "shared_folder", "shuffle_width", "utf8", "whole_text"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(text: str | Column = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def own_name(taken: list[str], name: str) -> str:
    """A column name like ``name`` that isn't among ``taken``."""
    used = {t.lower() for t in taken}
    name = f"__{name}"
    while name in used:
        name = f"_{name}"
    return name


def commonest(counted: DataFrame, n: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the largest counts ``n``, in descending order; of equal counts those of the least hash of ``key``.

    Histograms of the counts' magnitudes, of the counts of the last magnitude and of the hashes' leading bits of the last
    count tell which rows these are, so one task sorts ``limit`` rows and the few that share the last hash's bits.
    """
    order = F.xxhash64(key)
    chosen, tied, left = F.lit(False), F.lit(True), limit
    for level in (-F.floor(F.log2(n) * 16), -F.col(n), F.shiftright(order, 48)):
        sizes = counted.where(tied).groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()
        last = None
        for row in sorted(sizes):
            if row["size"] > left:
                last = row["level"]
                break
            left -= row["size"]
        if last is None:
            break
        chosen, tied = chosen | (tied & (level < last)), tied & (level == last)
    return counted.where(chosen | tied).orderBy(F.desc(n), order, key).limit(limit)


def repeat_rows(df: DataFrame, copies: str, number: str = "copy") -> DataFrame:
    """Each row as many times as column ``copies`` says, numbered from 1 in column ``number``."""
    return df.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null ones as empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


#: Bytes of words stand for themselves in lower case, others for a blank; UTF-8 beyond ASCII is of words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII."""
    return text.translate(_WORDS).split()
