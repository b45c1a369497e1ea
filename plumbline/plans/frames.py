"""Tables as the statistical operators want them, from the generic star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.splits import leads
from plumbline.sources.tables import table

#: Spans of a 16-sample lead, inclusive.
SPANS = {"p": (1, 3), "qrs": (5, 8), "t": (10, 13)}
LEADS = 4


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits, negative zero to zero; whole numbers to long."""
    kinds = dict(df.dtypes)
    out = {c: F.round(F.col(c), digits) + F.lit(0.0) if k == "double" else F.col(c).cast("long") if k in ("int", "bigint", "tinyint", "smallint") else F.col(c) for c, k in kinds.items()}
    return df.select(*[v.alias(c) for c, v in out.items()])


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each order: features of its lines, its customer's covariates, a target with planted parts, its fold."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    f = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    f = f.withColumn("age", (F.col("o_custkey") % 70 + 18).cast("double")).withColumn("sex", (F.col("o_custkey") % 2).cast("double")).withColumn("fold", F.col("o_custkey") % 5)
    noise = (F.col("o_orderkey") * 7919 % 1000).cast("double") / 100.0
    return f.withColumn("y", 0.1 * F.col("qty") + 2.0 * F.col("lines") - 30.0 * F.col("disc") + 0.05 * F.col("age") + noise)


#: The same frame in SQL.
ORDER_SQL = """a as (select l_orderkey, count(*)::double as lines, sum(l_quantity) as qty, avg(l_discount) as disc, avg(l_tax) as tax
 from lineitem group by l_orderkey),
f as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice, lines, qty, disc, tax, (o_custkey % 70 + 18)::double as age,
 (o_custkey % 2)::double as sex, o_custkey % 5 as fold,
 0.1::double * qty + 2.0::double * lines - 30.0::double * disc + 0.05::double * (o_custkey % 70 + 18)::double + ((o_orderkey * 7919) % 1000)::double / 100.0::double as y
 from orders join a on l_orderkey = o_orderkey)"""


def user_signal(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each event: the user's samples, in order of time and id; seconds since the epoch."""
    e = table(spark, folder, "events")
    return e.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0))


def lead_samples(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, lead, at, x, segment: an embedding as LEADS leads with named segments."""
    from plumbline.operators.segments import segment_of

    e = table(spark, folder, "embeddings")
    return leads(e, "vec_id", "embedding", LEADS).withColumn("segment", segment_of(F.col("at"), SPANS))


LEAD_SQL = """u as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
s as (select vec_id, (i // 16)::int as lead, (i % 16)::int as "at", x,
 case when i % 16 between 5 and 8 then 'qrs' when i % 16 between 1 and 3 then 'p' when i % 16 between 10 and 13 then 't' else 'other' end as segment from u)"""
