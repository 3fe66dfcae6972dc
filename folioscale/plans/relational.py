"""Queries of general operators on the star schema and the event table; x_ ones are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.operators import matching, sequences
from folioscale.plans.registry import Registry
from folioscale.runtime import read_table
from folioscale.streaming import incremental

registry = Registry()
query = registry.query


@query("select customer.c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%' and o_totalprice > 100000)")
def orphan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order of a high price."""
    urgent = read_table(spark, sf_dir, "orders").where("o_orderpriority like '1%' and o_totalprice > 100000")
    return read_table(spark, sf_dir, "customer").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("with t as (select n_nationkey, n_name, r_name, s_suppkey from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey) select s_suppkey as id, 'nation:' || n_nationkey as ancestor, 1 as distance from t union all select s_suppkey, 'region:' || r_name, 2 from t")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under nations under regions: all ancestors of each supplier."""
    nation = read_table(spark, sf_dir, "nation").join(F.broadcast(read_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("node"), F.concat(F.lit("nation:"), "s_nationkey").alias("parent"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"), F.concat(F.lit("region:"), "r_name").alias("parent")))
    return sequences.ancestors(nodes, "node", "parent", 2).where("id like 's:%'").select(F.substring_index("id", ":", -1).cast("long").alias("id"), "ancestor", "distance")


@query("select region.r_name, n_name, count(*) as orders_, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    # summed by customer before the joins, so that only one row a customer is shuffled on
    sums = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("t"))
    joined = sums.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.sum("n").alias("orders_"), F.round(F.sum("t"), 2).cast("double").alias("total"))


@query("select l_returnflag, l_linestatus, sum(l_quantity)::bigint as quantity, round(avg(l_discount), 4) as discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("select o_custkey, o_orderkey, place::int as place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3")
def leading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.leading(read_table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("select o_orderkey, after, before from (select l_orderkey as o_orderkey, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as after, l_linenumber as before from (select distinct l_orderkey, l_linenumber from lineitem)) where before - after > 1")
def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return sequences.gaps(rows, "l_linenumber", "o_orderkey")


@query("select p_brand, count(*) as n, 'both' as side from (select p_brand from part where p_size < 10 intersect select p_brand from part where p_size > 40) group by p_brand union all select p_brand, count(*), 'either' from (select p_brand from part where p_size < 10 union select p_brand from part where p_size > 40) group by p_brand union all select p_brand, count(*), 'small' from (select p_brand from part where p_size < 10 except select p_brand from part where p_size > 40) group by p_brand")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    small, large = part.where("p_size < 10").select("p_brand"), part.where("p_size > 40").select("p_brand")
    side = lambda rows, name: rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return side(small.intersect(large), "both").unionByName(side(small.union(large).distinct(), "either")).unionByName(side(small.exceptAll(large).distinct().join(large, "p_brand", "left_anti"), "small"))


@query("select p_partkey, p_name, hits from (select p_partkey, p_name, len(list_filter(string_split(p_name, ' '), lambda t: contains(t, 'a'))) + len(list_filter(string_split(p_name, ' '), lambda t: contains(t, 'e'))) as hits from part) where hits >= 3")
def name_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.operators import tags

    rows = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("tokens"))
    return tags.search(rows, "tokens", ["a", "e"]).where("hits >= 3").select("p_partkey", "p_name", "hits")


@query("""with h as (select user_id, event_id, ts, value >= (select avg(value) from events) as hit, row_number() over (partition by user_id order by ts, event_id) as n from events),
    m as (select *, sum((not hit)::int) over (partition by user_id order by n rows between 2 preceding and current row) as miss from h), s as (select *, max((miss >= 3)::int) over (partition by user_id order by n rows unbounded preceding) as stop from m)
    select user_id, count(*) as hits from s where stop = 0 and hit group by user_id""")
def hits_until_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above the mean value of each user, before the first three below it in a row."""
    events = read_table(spark, sf_dir, "events")
    # one row, joined by a constant
    mean = F.broadcast(events.agg(F.avg("value").alias("mean"), F.lit(1).alias("k")))
    rows = events.withColumn("k", F.lit(1)).join(mean, "k").select("user_id", "event_id", "ts", (F.col("value") >= F.col("mean")).alias("hit"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sequences.until_misses(rows, "hit", "user_id", "n").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))


@query("with d as (select user_id, event_type, min(event_id) as event_id, min(ts)::date::varchar as day from events group by user_id, event_type) select day, count(*) as new_pairs from d group by day")
def incremental_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by day, pairs of user and type not seen on an earlier day."""
    return incremental.first_seen(read_table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value, count(*) as writes from events group by user_id, event_type")
def log_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after all events were upserted: the last value of each key and how often it was written."""
    return incremental.upserted(read_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("select ts::date::varchar as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def x_tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", "total")


@query("""with g as (select user_id, ts, (ts - lag(ts) over (partition by user_id order by ts)) >= interval 30 minute as cut from events), s as (select *, sum(coalesce(cut, true)::int) over (partition by user_id order by ts rows unbounded preceding) as session from g)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, session""")
def x_session_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("select event_type, count(*) as n, round(avg(value), 4) as mean from events where ts >= (select max(ts) from events) - interval 5 day group by event_type")
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five days, as a scheduled scan looks back."""
    events = read_table(spark, sf_dir, "events")
    last = F.broadcast(events.agg(F.max("ts").alias("last"), F.lit(1).alias("k")))
    rows = events.withColumn("k", F.lit(1)).join(last, "k").where(F.col("ts") >= F.col("last") - F.expr("interval 5 days"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
