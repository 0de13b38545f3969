"""The engine's logical tables, derived from the star-schema test tables.

Parts stand for cited papers, customers for citing papers, order lines for citation
edges and documents for abstracts. Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas spare one footer-reading job per table.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    label = F.when(F.col("l_returnflag") == "A", "background").when(F.col("l_returnflag") == "N", "methodology")
    label = label.otherwise("result")
    one, gap = F.array(label), F.lit(None).cast("array<string>")
    rich = F.array(one, gap, F.array(F.lit("background"), F.lit(None).cast("string"), F.lit("")))
    unlabelled = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")) * 100
            + F.col("l_quantity").cast("long")
        ).alias("citationid"),
        F.col("o_custkey").alias("citingcorpusid"),
        F.col("l_partkey").alias("citedcorpusid"),
        (F.col("l_discount") >= 0.05).alias("isinfluential"),
        F.when(F.col("l_linestatus") != "O", F.array("l_returnflag", F.col("l_linenumber").cast("string")))
        .alias("contexts"),
        F.when(~unlabelled, F.when(F.col("l_linenumber") >= 4, rich).otherwise(F.array(one))).alias("intents"),
    )


def cited_papers(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("citedcorpusid").alias("corpusid")).agg(
        F.count(F.lit(1)).cast("int").alias("citationcount"),
        F.sum(F.col("isinfluential").cast("int")).cast("int").alias("influentialcitationcount"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("corpusid"),
        F.when(F.col("p_type") != "ECONOMY", F.concat_ws("-", "p_type", "p_partkey")).alias("acl_id"),
        F.col("p_name").alias("title"),
        F.array(F.concat(F.lit("A"), F.col("p_size")), F.col("p_brand")).alias("authors"),
        (F.lit(1985) + F.floor(F.col("p_size") / 4)).cast("int").alias("year"),
        F.lit(None).cast("string").alias("publicationdate"),
        F.col("p_brand").alias("venue"),
        F.array(F.concat(F.lit("F"), F.col("p_size")), F.col("p_type")).alias("s2fieldsofstudy"),
    )
    return parts.join(counts, "corpusid", "left")


def citing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_date"), F.count(F.lit(1)).cast("int").alias("citationcount")
    )
    return table(spark, sf_dir, "customer").join(dates, "c_custkey", "left").select(
        F.col("c_custkey").alias("corpusid"),
        F.col("c_name").alias("title"),
        F.array(F.concat(F.lit("A"), F.col("c_nationkey")), F.col("c_name")).alias("authors"),
        F.year("first_date").alias("year"),
        F.when(F.col("c_acctbal") >= 0, F.date_format("first_date", "yyyy-MM-dd")).alias("publicationdate"),
        F.col("c_mktsegment").alias("venue"),
        "citationcount",
        F.array(F.concat(F.lit("F"), F.col("c_nationkey")), F.col("c_mktsegment")).alias("s2fieldsofstudy"),
    )


def citing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias("corpusid"), F.concat_ws("-", F.lit("C"), "c_custkey").alias("acl_id")
    )


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("corpusid"), F.col("text").alias("abstract")
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpusid"), "lang")


def vector_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(generations, targets) over all embeddings: seed = label, side = language of the document.

    Vectors of English documents are targets, all others are generations.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    vectors = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(
        F.col("label").alias("seed_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"),
        (F.coalesce("lang", F.lit("")) == "en").alias("is_target"),
    )
    return vectors.where(~F.col("is_target")).drop("is_target"), vectors.where("is_target").drop("is_target")
