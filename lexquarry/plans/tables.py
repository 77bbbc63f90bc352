"""Relational extras over the star schema and the event table, beyond the operators of the domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.plans.registry import query
from lexquarry.sources.tables import read_table


def _cents(c):
    return F.sum(F.round(F.col(c) * 100).cast("long"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS qty_100, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_100, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""",
)
def _pricing(spark, d):
    rows = read_table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(_cents("l_quantity").alias("qty_100"), _cents("l_extendedprice").alias("price_100"), F.count(F.lit(1)).alias("n"))


@query(
    "nation_revenue",
    """SELECT n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_100 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _nation(spark, d):
    t = {n: read_table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    customers = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    sold = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy("n_name").agg(_cents("l_extendedprice").alias("revenue_100"))


@query(
    "cube_counts",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def _cube(spark, d):
    return read_table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "asof_events",
    """SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN
(SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def _asof(spark, d):
    """The last view at or before each purchase of a user, as one pass over a window, not a range join."""
    rows = read_table(spark, d, "events").where("event_type in ('purchase', 'view')")
    rank = F.when(F.col("event_type") == "view", 0).otherwise(1)
    from pyspark.sql import Window

    earlier = Window.partitionBy("user_id").orderBy("ts", rank, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(earlier)
    return rows.select("event_id", "event_type", view.alias("view_id")).where("event_type = 'purchase'").drop("event_type")


@query(
    "sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def _sessions(spark, d):
    grouped = read_table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query(
    "top_orders",
    "SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price_100 FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def _top(spark, d):
    top = read_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price_100"))


@query(
    "set_operations",
    """SELECT kind, count(*) AS n FROM (SELECT 'both' AS kind, * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'only_customers', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) GROUP BY kind""",
)
def _sets(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    both = c.intersect(s).select(F.lit("both").alias("kind")).unionAll(c.subtract(s).select(F.lit("only_customers").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
