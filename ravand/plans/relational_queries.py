"""Relational queries over the star-schema and event tables (X). Money is summed as decimals, so order changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravand.operators.islands import with_head, with_previous, with_rank, with_total_before
from ravand.plans.registry import query, table

c, lit, when = F.col, F.lit, F.when


def dec(x):
    return x.cast("decimal(18,2)")


def _us(name: str):
    return F.unix_micros(c(name).cast("timestamp"))


REVENUE = "cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))) as decimal(18,4))"


@query("x01_lineitem_summary", "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(dec(c("l_quantity"))).cast("double").alias("sum_qty"), F.sum(dec(c("l_extendedprice"))).cast("double").alias("sum_price"), F.count(lit(1)).alias("n"))


@query("x02_nation_revenue", f"select r_name, n_name, cast(sum({REVENUE}) as double) as revenue from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by r_name, n_name")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), c("r_regionkey") == c("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t("customer").join(places, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name", "r_name")
    sold = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(F.sum(F.expr(REVENUE)).alias("v"))  # summed before the wide join
    return sold.join(buyers, c("o_custkey") == c("c_custkey")).groupBy("r_name", "n_name").agg(F.sum("v").cast("double").alias("revenue"))


@query("x03_with_orders", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("x04_without_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("x05_cube", "select o_orderpriority, o_orderstatus, count(*) as n, cast(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) as bigint) as level from orders group by cube(o_orderpriority, o_orderstatus)")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("x05_rollup", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by rollup(o_orderpriority, o_orderstatus)")
def x05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(lit(1)).alias("n"))


@query("x06_windows", "select o_orderkey, rank() over w as rank, dense_rank() over w as dense_rank, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as quarter, coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), -1) as before, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as double) as running from orders window w as (partition by o_custkey order by o_orderpriority)")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, quarters, the row before and running totals of each customer; months are the buckets, so no window spans a customer's rows.

    Ranks by priority follow from the counts of the priorities, which are few.
    """
    key, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", F.trunc("o_orderdate", "month").alias("month"))
    counts = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(lit(1)).alias("k"))
    by_priority = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    ranks = counts.select("o_custkey", "o_orderpriority", (F.coalesce(F.sum("k").over(by_priority.rowsBetween(Window.unboundedPreceding, -1)), lit(0)) + 1).alias("rank"), F.row_number().over(by_priority).alias("dense_rank"))
    o = with_rank(o, key, c("month"), order, "r", "n")
    o = with_previous(o, key, "month", order, {"before": "o_orderkey"})
    o = with_total_before(o, key, "month", order, dec(c("o_totalprice")), "running")
    # the first n % 4 quarters have one row more
    more, least = c("n") % 4, F.floor(c("n") / 4)
    quarter = when(c("r") <= more * (least + 1), F.ceil(c("r") / (least + 1))).otherwise(more + F.ceil((c("r") - more * (least + 1)) / least))
    return o.join(ranks, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "rank", "dense_rank", quarter.alias("quarter"), F.coalesce("before", lit(-1)).alias("before"), c("running").cast("double").alias("running"))


@query("x07_top_items", "select l_orderkey, l_linenumber, r from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r from lineitem) where r <= 3")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(c("l_extendedprice").desc(), "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).where("r <= 3")


@query("x08_set_operations", "select 'union' as op, k from (select p_partkey as k from part union select l_partkey from lineitem) union all select 'intersect', k from (select p_partkey as k from part intersect select l_partkey from lineitem) union all select 'except', k from (select p_partkey as k from part except select l_partkey from lineitem)")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "part").select(c("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("k"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for op, df in named.items():
        part = df.select(lit(op).alias("op"), "k")
        out = part if out is None else out.unionByName(part)
    return out


@query("x09_distinct_users", "select event_type, count(distinct user_id) as users, count(*) as n from events group by event_type")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(lit(1)).alias("n"))


@query("x09_approximate_users")
def x09b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("x10_tumbling", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(lit(1)).alias("n")).select(c("w.start").alias("start"), "event_type", "n")


@query("x10_sliding", "select b - k * interval '15 minutes' as start, count(*) as n from (select time_bucket(interval '15 minutes', ts, timestamp '1970-01-01') as b, unnest([0, 1, 2, 3]) as k from events) group by 1")
def x10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(lit(1)).alias("n")).select(c("w.start").alias("start"), "n")


@query(
    "x11_sessions",
    """with p as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events), g as (select *, sum(case when before is null or epoch_us(ts) - epoch_us(before) >= 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from p)
       select user_id, min(ts) as start, max(ts) as finish, count(*) as n from g group by user_id, s""",
)
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, a gap of half an hour or more begins a new one; days are the buckets."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    e = with_previous(e, ["user_id"], "day", ["ts", "event_id"], {"before": "ts"})
    e = with_head(e, ["user_id"], "day", ["ts", "event_id"], c("before").isNull() | (_us("ts") - _us("before") >= 1_800_000_000))
    return e.groupBy("user_id", "head").agg(F.max("ts").alias("finish"), F.count(lit(1)).alias("n")).select("user_id", c("head.ts").alias("start"), "finish", "n")


@query("x12_as_of", "select event_id, (select max(v.ts) from events v where v.user_id = p.user_id and v.event_type = 'view' and v.ts < p.ts) as last_view from events p where event_type = 'purchase'")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase of a user; days are the buckets, at one time purchases come before views."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").select("user_id", "ts", "event_id", (c("event_type") == "view").cast("int").alias("is_view"), F.to_date("ts").alias("day"))
    e = with_head(e, ["user_id"], "day", ["ts", "is_view", "event_id"], c("is_view") == 1)
    return e.where("is_view = 0").select("event_id", c("head.ts").alias("last_view"))


_BANDS = ((0, 20, "low"), (20, 60, "middle"), (60, 120, "high"), (120, 1_000_000, "top"))


@query("x13_bands", "select band, count(*) as n from events join (values (0, 20, 'low'), (20, 60, 'middle'), (60, 120, 'high'), (120, 1000000, 'top')) as b(lo, hi, band) on value >= lo and value < hi group by band")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join with a fixed table of four bands."""
    bands = spark.createDataFrame(list(_BANDS), "lo int, hi int, band string")
    return table(spark, sf_dir, "events").join(F.broadcast(bands), (c("value") >= c("lo")) & (c("value") < c("hi"))).groupBy("band").agg(F.count(lit(1)).alias("n"))


@query("x14_json_histogram", "select cast(props->>'$.k' as bigint) as k, count(*) as n from events group by 1")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(lit(1)).alias("n"))


@query("x15_pivot", "select cast(cast(ts as date) as varchar) as day, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'click') as click from events group by 1")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", ["view", "purchase", "click"]).agg(F.count(lit(1)))
    return p.fillna(0)


@query("x16_above_average", "select o_orderkey from orders o where cast(o_totalprice as decimal(18,2)) > (select sum(cast(o_totalprice as decimal(18,2))) / count(*) from orders i where i.o_custkey = o.o_custkey)")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", dec(c("o_totalprice")))
    mean = o.groupBy("o_custkey").agg(F.sum("p").alias("s"), F.count(lit(1)).alias("n"))
    return o.join(mean, "o_custkey").where(c("p") * c("n") > c("s")).select("o_orderkey")
