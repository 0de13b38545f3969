"""Exact de-duplication with a heavy-hitter split.

Misra-Gries counters (``DataFrame.stat.freqItems`` keeps 1/support of them per task and merges them) name every digest that
can hold more than ``support`` of the rows. Their exact sizes and winners are aggregated with map-side combination,
verified, and broadcast, which their number bounds; rows of those digests are settled where they are read. All other
digests meet in an ordinary shuffle, in which none of them can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, numbered, table, text_of, unused, without

# Share of all rows from which a digest counts as frequent; 1 / SUPPORT bounds the broadcast rows.
SUPPORT = 0.002


def digest(text):
    """SHA-256 of the text in UTF-8 after lower-casing A-Z only."""
    return F.sha2(ascii_lower(text_of(text)).cast("binary"), 256)


def winners(digests: DataFrame) -> DataFrame:
    """Per digest its number of rows and the winning (doc_id, _row), both ties and nulls ordered."""
    return digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("winner"),
    )


def decide(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Rows (doc_id, digest, _row) with group_size, keep_id and kept.

    The largest doc_id stays; a null id loses against any other, and of rows that repeat the
    id too, one stays. An empty table gives no rows. ``digests`` is read several times and
    should be a stored table.
    """
    items = digests.select("digest").stat.freqItems(["digest"], support)
    candidates = items.select(F.explode("digest_freqItems").alias("digest"))
    frequent = materialise(winners(digests.join(F.broadcast(candidates), "digest")))
    # Misra-Gries names candidates, the exact count verifies them; at most 2 / support digests can pass.
    total = digests.agg(F.count(F.lit(1)).alias("n_rows"))
    verified = frequent.join(F.broadcast(total), F.col("group_size") >= F.col("n_rows") * support / 2).drop("n_rows")
    marked = digests.join(F.broadcast(verified), "digest", "left")
    settled = marked.where(F.col("winner").isNotNull())
    rest = marked.where(F.col("winner").isNull()).select(digests.columns)
    shuffled = rest.join(winners(rest), "digest")
    return settled.unionByName(shuffled).select(
        "doc_id", "digest", "_row", "group_size", F.col("winner.doc_id").alias("keep_id"),
        (F.col("winner._row") == F.col("_row")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; texts equal after lower-casing A-Z form a group. Other columns
    of ``docs`` are not read.
    """
    digests = numbered(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest")))
    return decide(digests, support).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    row = unused(docs, "_row")
    stored = numbered(docs, row)
    digests = materialise(stored.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), F.col(row).alias("_row")))
    loser = unused(stored, "_loser")
    losers = materialise(decide(digests, support).where(~F.col("kept")).select(F.col("_row").alias(loser)))
    return without(stored, row, losers, loser).select(docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH digests AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), sized AS (
  SELECT doc_id, sha256(body) AS text_sha256, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
  FROM digests WINDOW same AS (PARTITION BY body)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM sized
"""
