"""General relational coverage: predicates, joins, aggregates, windows, sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evigraph.operators.bounds import dealt
from evigraph.sources.shared import new_path
from evigraph.sources.tables import Tables

from .registry import query


def money(column: str | Column) -> Column:
    """Exact sums: add as decimals, return a double."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")).cast("double")


def long(column: Column) -> Column:
    return column.cast("long")


# --- predicates and projection ----------------------------------------------


@query("p01_predicates", "SELECT p_partkey, p_brand FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 30 AND (p_retailprice > 1200 OR NOT p_brand = 'Brand#11')")
def p01(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").like("%a%") & F.col("p_size").between(5, 30) & ((F.col("p_retailprice") > 1200) | ~(F.col("p_brand") == "Brand#11"))).select("p_partkey", "p_brand")


@query("p02_case_coalesce", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def p02(t: Tables) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return t.customer.select("c_custkey", band.alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("p03_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def p03(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_custkey") == 7)).select("o_orderkey", "o_totalprice")


@query("p04_projection", "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45")
def p04(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("p05_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def p05(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


# --- joins --------------------------------------------------------------------


@query("j01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def j02(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j03_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON o_custkey = c_custkey")
def j03(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 5000").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("j04_full", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 15) FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 5) ON s_nationkey = n_nationkey")
def j04(t: Tables) -> DataFrame:
    return t.supplier.where("s_nationkey < 15").join(t.nation.where("n_nationkey > 5"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("s_suppkey", "n_name")


@query("j05_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j05(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j06(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j07_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def j07(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("j08_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j08(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(F.broadcast(b), F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


_PAIR = "a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS"


@query("j09_interval", f"SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON {_PAIR} WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def j09(t: Tables) -> DataFrame:
    a, b = t.events.where("event_type = 'click'").alias("a"), t.events.where("event_type = 'purchase'").alias("b")
    return a.join(b, F.expr(_PAIR)).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query("j10_asof", "SELECT p.event_id AS event_id, v.event_id AS last_view, v.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts")
def j10(t: Tables) -> DataFrame:
    """The last earlier view of each purchase: one sort by user, no pairs."""
    before = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    view = F.last(F.when(F.col("event_type") == "view", F.struct("event_id", "value")), ignorenulls=True).over(before)
    used = t.events.where(F.col("event_type").isin("purchase", "view")).withColumn("v", view)
    return used.where("event_type = 'purchase' AND v IS NOT NULL").select("event_id", F.col("v.event_id").alias("last_view"), F.col("v.value").alias("value"))


@query("j11_lateral", "SELECT c_custkey, n, top FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey)")
def j11(t: Tables) -> DataFrame:
    return t.view("customer", "orders").sql("SELECT c_custkey, n, top FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey)")


@query("j12_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def j12(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("j13_join_hints", "SELECT n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def j13(t: Tables) -> DataFrame:
    """Nations are broadcast; suppliers, which grow, are hashed after a shuffle."""
    return t.lineitem.join(t.supplier.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("j14_co_located", "SELECT o_orderpriority, sum(l_quantity)::DOUBLE AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def j14(t: Tables) -> DataFrame:
    """Both sides dealt by the same key once; the join adds no exchange."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    o = t.orders.select("o_orderkey", "o_orderpriority").repartition(n, "o_orderkey")
    items = t.lineitem.select("l_orderkey", "l_quantity").repartition(n, "l_orderkey")
    return items.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.sum("l_quantity").alias("quantity"))


@query("j14_bucketed", "SELECT o_orderstatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j14b(t: Tables) -> DataFrame:
    """Both sides stored in buckets of the key: neither side is shuffled for the join.

    The files are in the shared folder; the names leave the catalogue once the
    plan has what it needs of them.
    """
    tag = uuid.uuid4().hex
    for name, columns, key in (("orders", ["o_orderkey", "o_orderstatus"], "o_orderkey"), ("lineitem", ["l_orderkey", "l_quantity"], "l_orderkey")):
        writer = getattr(t, name).select(*columns).repartition(8, key).write.format("parquet")
        writer.bucketBy(8, key).sortBy(key).option("path", new_path(t.spark)).saveAsTable(f"evigraph_{name}_{tag}")
    o, items = (t.spark.table(f"evigraph_{n}_{tag}") for n in ("orders", "lineitem"))
    both = items.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    for name in ("orders", "lineitem"):
        t.spark.sql(f"DROP TABLE evigraph_{name}_{tag}")
    return out


# --- aggregation --------------------------------------------------------------


@query("k01_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def k01(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), money("l_extendedprice").alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("k02_distinct_agg", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def k02(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@query("k03_grouping_sets", _SETS)
def k03(t: Tables) -> DataFrame:
    return t.view("orders").sql(_SETS)


@query("k04_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def k04(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"))


@query("k05_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def k05(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("k06_filtered_agg", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders")
def k06(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("k07_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def k07(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("k08_percentile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def k08(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("k09_moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1")
def k09(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"))


def _near(estimate: Column, exact: Column, share: float) -> Column:
    return F.abs(estimate - exact) <= share * exact


@query("k10_approx_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS within FROM orders GROUP BY 1")
def k10(t: Tables) -> DataFrame:
    """The exact count, and whether the sketch is within 5 % of it."""
    both = t.orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.01).alias("near"), F.countDistinct("o_custkey").alias("exact"))
    return both.select("o_orderstatus", "exact", _near(F.col("near"), F.col("exact"), 0.05).alias("within"))


@query("k11_approx_percentile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS exact, true AS within FROM orders GROUP BY 1")
def k11(t: Tables) -> DataFrame:
    both = t.orders.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", 0.5, 10000).alias("near"), F.percentile("o_totalprice", 0.5).alias("exact"))
    return both.select("o_orderstatus", F.round("exact", 4).alias("exact"), _near(F.col("near"), F.col("exact"), 0.02).alias("within"))


@query("k12_approx_top_k", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1")
def k12(t: Tables) -> DataFrame:
    """Exact here, since there are fewer kinds than the sketch holds."""
    return t.view("events").sql("SELECT explode(approx_top_k(event_type, 10)) AS x FROM events").select(F.col("x.item").alias("item"), F.col("x.count").alias("n"))


@query("k13_theta_sketch", """SELECT count(*) AS exact, true AS within FROM (
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def k13(t: Tables) -> DataFrame:
    """Customers with an open and with a finished order: exactly, and whether
    the intersection of two sketches is within 5 % of that."""
    return t.view("orders").sql("""
        WITH s AS (SELECT theta_sketch_agg(o_custkey) FILTER (WHERE o_orderstatus = 'F') AS f, theta_sketch_agg(o_custkey) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders),
        e AS (SELECT count(*) AS exact FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
        SELECT exact, abs(theta_sketch_estimate(theta_intersection(f, o)) - exact) <= 0.05 * exact AS within FROM s, e""")


@query("k14_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def k14(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("k15_unpivot", "SELECT s_suppkey, 'nation' AS what, s_nationkey::DOUBLE AS amount FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def k15(t: Tables) -> DataFrame:
    wide = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return wide.unpivot("s_suppkey", ["nation", "balance"], "what", "amount")


@query("k16_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def k16(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("k17_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY 1")
def k17(t: Tables) -> DataFrame:
    key = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("top"), F.min_by("o_orderkey", key).alias("low"))


@query("k18_mode", "SELECT g, event_type AS mode FROM (SELECT user_id % 10 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, event_type) = 1")
def k18(t: Tables) -> DataFrame:
    counts = t.events.groupBy((F.col("user_id") % 10).alias("g"), "event_type").count()
    return counts.groupBy("g").agg(F.min_by("event_type", F.struct(-F.col("count"), F.col("event_type"))).alias("mode"))


# --- windows ------------------------------------------------------------------



def _by_cust() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")


def _by_priority() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderpriority")


def _whole() -> WindowSpec:
    return _by_cust().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey{})"
_FULL = " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _window(name: str, sql: str, column: Callable[[], Column]) -> None:
    """Columns are made when a plan is: that takes a session."""

    def plan(t: Tables) -> DataFrame:
        return t.orders.select("o_orderkey", column().alias("w"))

    query(name, f"SELECT o_orderkey, {sql} AS w FROM orders")(plan)


_OVER_P = "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"
_window("w01_row_number", "row_number() " + _OVER.format(""), lambda: long(F.row_number().over(_by_cust())))
_window("w02_rank", "rank() " + _OVER_P, lambda: long(F.rank().over(_by_priority())))
_window("w03_dense_rank", "dense_rank() " + _OVER_P, lambda: long(F.dense_rank().over(_by_priority())))
_window("w04_ntile", "ntile(4) " + _OVER.format(""), lambda: long(F.ntile(4).over(_by_cust())))
_window("w05_percent_rank", f"round(percent_rank() {_OVER_P} + cume_dist() {_OVER_P}, 6)", lambda: F.round(F.percent_rank().over(_by_priority()) + F.cume_dist().over(_by_priority()), 6))
_window("w06_lag", "lag(o_orderkey, 1, -1) " + _OVER.format(""), lambda: F.lag("o_orderkey", 1, -1).over(_by_cust()))
_window("w07_lead", "lead(o_orderkey, 2) " + _OVER.format(""), lambda: F.lead("o_orderkey", 2).over(_by_cust()))
_window("w08_first_value", "first_value(o_orderkey) " + _OVER.format(""), lambda: F.first("o_orderkey").over(_by_cust()))
_window("w09_last_value", "last_value(o_orderkey) " + _OVER.format(_FULL), lambda: F.last("o_orderkey").over(_whole()))
_window("w10_rows_frame", "sum(o_totalprice::DECIMAL(18,2)) " + _OVER.format(" ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING") + "::DOUBLE", lambda: F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(_by_cust().rowsBetween(-2, 1)).cast("double"))
_window("w12_nth_value", "nth_value(o_orderkey, 2) " + _OVER.format(_FULL), lambda: F.nth_value("o_orderkey", 2).over(_whole()))

_RANGE = "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events"


@query("w11_range_frame", _RANGE)
def w11(t: Tables) -> DataFrame:
    """A running count of each hour, and what is left of the hour before.

    A frame over whole types would be a task for each and would count its rows
    again for each row. Rows of one time have one count, so times are counted
    once; a probe an hour before each tells what of that hour is still inside.
    """
    hour = lambda ts: F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)
    times = t.events.groupBy("event_type", "ts").agg(F.count("*").alias("c"))
    marks = times.select("event_type", "ts", F.col("ts").alias("at"), F.lit(1).alias("kind"), "c")
    before = times.where("ts IS NOT NULL").select("event_type", "ts", F.expr("ts - INTERVAL 1 HOUR").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("c"))
    both = marks.unionByName(before).withColumn("hour", hour(F.col("at")))
    within = Window.partitionBy("event_type", "hour")
    so_far = F.sum("c").over(within.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    both = both.select("event_type", "ts", F.when(F.col("kind") == 1, so_far).otherwise(F.sum("c").over(within) - so_far).alias("n"))
    rows = t.events.select("event_type", "ts", "event_id", F.lit(None).cast("long").alias("n"), F.lit(True).alias("own"))
    rows = rows.unionByName(both.select("event_type", "ts", F.lit(None).cast(t.events.schema["event_id"].dataType).alias("event_id"), "n", F.lit(False).alias("own")))
    rows = dealt(rows, 3 * t.events.count(), "event_type", "ts")
    return rows.withColumn("n", F.sum("n").over(Window.partitionBy("event_type", "ts"))).where("own").select("event_id", "n")


# --- sort, limit, sets, subqueries --------------------------------------------


@query("l01_sort", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment NULLS LAST, c_custkey")
def l01(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")).orderBy(F.asc_nulls_last("segment"), "c_custkey")


@query("l02_limit", "SELECT count(*) AS n, true AS known FROM (SELECT o_orderkey FROM orders LIMIT 7)")
def l02(t: Tables) -> DataFrame:
    """Seven rows, whichever they are; all are rows of the table."""
    few = t.orders.select("o_orderkey").limit(7)
    return few.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count("*").alias("n"), (F.count("*") == 7).alias("known"))


@query("l03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def l03(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(10)


@query("l04_group_top_k", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def l04(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", long(F.row_number().over(w))).where("r <= 2").select("o_custkey", "o_orderkey", "r")


@query("l05_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 5 OFFSET 7")
def l05(t: Tables) -> DataFrame:
    return t.part.orderBy("p_retailprice", "p_partkey").offset(7).limit(5).select("p_partkey")


_CN, _SN = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 5000"


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal < 5000").select(F.col("s_nationkey").alias("k"))


def _set(name: str, word: str, op) -> None:
    query(name, f"{_CN} {word} {_SN}")(lambda t: op(*_two(t)))


_set("s01_union_all", "UNION ALL", lambda a, b: a.unionByName(b))
_set("s02_union", "UNION", lambda a, b: a.unionByName(b).distinct())
_set("s03_intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set("s03_intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
_set("s05_except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))


@query("s04_except", "SELECT p_size AS k FROM part WHERE p_size > 10 EXCEPT SELECT p_size FROM part WHERE p_retailprice > 1900")
def s04(t: Tables) -> DataFrame:
    return t.part.where("p_size > 10").select(F.col("p_size").alias("k")).subtract(t.part.where("p_retailprice > 1900").select("p_size"))


_SUBQUERIES = {
    "q01_scalar_subquery": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "q02_exists": ("orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"),
    "q02_not_exists": ("orders lineitem", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)"),
    "q03_in_subquery": ("customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "q04_correlated": ("customer orders", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer"),
    "r01_recursive": ("nation region", "WITH RECURSIVE r(node, depth) AS (SELECT concat('r', r_regionkey), 0 FROM region WHERE r_regionkey = 1 UNION ALL SELECT e.child, r.depth + 1 FROM r JOIN (SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child FROM nation) e ON e.parent = r.node WHERE r.depth < 3) SELECT node, depth FROM r"),
}
for _name, (_tables, _sql) in _SUBQUERIES.items():
    query(_name, _sql)(lambda t, names=_tables, text=_sql: t.view(*names.split()).sql(text))


@query("m01_sample")
def m01(t: Tables) -> DataFrame:
    return t.orders.sampleBy("o_orderstatus", {"F": 0.1, "O": 0.1, "P": 0.5}, seed=3).select("o_orderkey", "o_orderstatus")
