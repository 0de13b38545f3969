"""Column picking and small rules shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitset import bit_set, cannot_contain, may_contain
from ..session import materialise

# Fixed value: white space that separates words, space and the five controls from tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def text_of(column: Column | str) -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Rows (doc_id, text) for Python, and the type of the id.

    The id travels as a string: a column of whole numbers with nulls would become floating point in pandas.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return rows, docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()


def unkeyed(df: DataFrame, kind: str, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast(kind))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def unused(df: DataFrame, name: str) -> str:
    """``name``, with a number behind it if ``df`` has such a column."""
    taken = {n.lower() for n in df.columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Stored copy of ``df`` with a row number that is the same for every later reader."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))


def split_by(df: DataFrame, name: str, members: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``name`` may be among the stored ``members``, and all other rows.

    A broadcast bit set of fixed size tells them apart where they are read, so of long texts only the first part needs a join.
    """
    bits = bit_set(members, member)
    return may_contain(df, name, bits), cannot_contain(df, name, bits)


def without(df: DataFrame, name: str, gone: DataFrame, member: str, same: Column | None = None) -> DataFrame:
    """The rows of ``df`` without a partner in the stored table ``gone``: equal keys and, if given, ``same``; other texts are not shuffled."""
    near, rest = split_by(df, name, gone, member)
    on = F.col(name) == F.col(member)
    # The optimiser pushes an anti-join below the bit set, to all rows; an outer join stays above it.
    met = near.join(gone, on if same is None else on & same, "left")
    return rest.unionByName(met.where(F.col(member).isNull()).select(df.columns))


__all__ = ["BLANKS", "WORD", "ascii_lower", "fold", "keyed", "materialise", "numbered", "split_by", "table", "text_of", "unkeyed", "unused", "without"]
