"""Scalar function families and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.sources.tables import Tables

from .registry import query


@query("x01_string", "SELECT c_custkey, upper(c_name) AS u, c_name[1:5] AS s, concat_ws('-', c_mktsegment, c_name) AS j, lpad(c_custkey::VARCHAR, 8, '0') AS p, replace(c_name, '0', 'o') AS r, reverse(c_name) AS v, split_part(c_name, '#', 2) AS x, instr(c_name, '#')::BIGINT AS i FROM customer")
def x01(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.customer.select("c_custkey", F.upper(name).alias("u"), F.substring(name, 1, 5).alias("s"), F.concat_ws("-", "c_mktsegment", name).alias("j"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("p"), F.replace(name, F.lit("0"), F.lit("o")).alias("r"), F.reverse(name).alias("v"), F.split_part(name, F.lit("#"), F.lit(2)).alias("x"), F.instr(name, "#").cast("long").alias("i"))


@query("x02_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_brand)::BIGINT AS d, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r FROM part")
def x02(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_brand").cast("long").alias("d"), F.regexp_replace("p_name", "[aeiou]", "*").alias("r"))


@query("x03_regex_hash", "SELECT page_id, regexp_extract(url, '([a-z]+)://', 1) AS scheme, md5(url) AS m, sha256(url) AS s FROM pages")
def x03(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "([a-z]+)://", 1).alias("scheme"), F.md5("url").alias("m"), F.sha2("url", 256).alias("s"))


@query("x04_url", "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages")
def x04(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY")).alias("query"))


@query("x05_date", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, quarter(o_orderdate)::BIGINT AS q, dayofyear(o_orderdate)::BIGINT AS d, last_day(o_orderdate)::DATE AS l, (o_orderdate::DATE + 30)::DATE AS a, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS n, date_trunc('month', o_orderdate)::DATE AS t FROM orders")
def x05(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.quarter(d).cast("long").alias("q"), F.dayofyear(d).cast("long").alias("d"), F.last_day(d).alias("l"), F.date_add(F.to_date(d), 30).alias("a"), F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).cast("long").alias("n"), F.to_date(F.date_trunc("month", d)).alias("t"))


@query("x06_day_of_week", "SELECT o_orderkey, dayofweek(o_orderdate)::BIGINT AS d FROM orders")
def x06(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.dayofweek("o_orderdate") - 1).cast("long").alias("d"))


@query("x07_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, greatest(c_acctbal, 100) AS g, floor(c_acctbal)::BIGINT AS f, sign(c_acctbal)::DOUBLE AS i, round(power(c_acctbal / 1000, 2), 6) AS p FROM customer")
def x07(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("a"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.round(F.ln(F.abs(b) + 1), 6).alias("l"), F.greatest(b, F.lit(100.0)).alias("g"), F.floor(b).alias("f"), F.sign(b).alias("i"), F.round(F.power(b / 1000, 2), 6).alias("p"))


@query("x08_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 3) AS r, (o_orderkey % 7)::BIGINT AS m FROM orders")
def x08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 7, 3).alias("r"), (F.col("o_orderkey") % 7).alias("m"))


@query("x09_array", "SELECT p_partkey, list_sort(list_transform(string_split(p_name, ' '), lambda x: upper(x))) AS t, len(list_filter(string_split(p_name, ' '), lambda x: len(x) > 4))::BIGINT AS n, list_contains(string_split(p_name, ' '), 'part') AS c, string_split(p_name, ' ')[1:2] AS s FROM part")
def x09(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_sort(F.transform(w, F.upper)).alias("t"), F.size(F.filter(w, lambda x: F.length(x) > 4)).cast("long").alias("n"), F.array_contains(w, "part").alias("c"), F.slice(w, 1, 2).alias("s"))


@query("x10_array_pairs", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS d, len(list_intersect([label, 1, 2], [1, 3]))::BIGINT AS n FROM embeddings")
def x10(t: Tables) -> DataFrame:
    e = F.col("embedding")
    both = F.zip_with(e, F.reverse(e), lambda a, b: a.cast("double") * b.cast("double"))
    shared = F.array_intersect(F.array(F.col("label"), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))
    return t.embeddings.select("vec_id", F.round(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), 6).alias("d"), F.size(shared).cast("long").alias("n"))


@query("x11_explode", "SELECT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def x11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))


@query("x12_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x12(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("x13_variant", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x13(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("x14_map_struct", "SELECT n_nationkey, n_name || ':' || n_regionkey AS pair FROM nation")
def x14(t: Tables) -> DataFrame:
    m = F.map_from_entries(F.array(F.struct(F.lit("name").alias("k"), F.col("n_name").alias("v")), F.struct(F.lit("region").alias("k"), F.col("n_regionkey").cast("string").alias("v"))))
    return t.nation.select("n_nationkey", F.concat(m["name"], F.lit(":"), m["region"]).alias("pair"))


@query("u01_pandas_udf", "SELECT c_custkey, round(c_acctbal * 1.1, 4) AS v FROM customer")
def u01(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def raised(s):
        return (s * 1.1).round(4)

    return t.customer.select("c_custkey", F.round(raised("c_acctbal"), 4).alias("v"))


@query("u02_grouped_map", "SELECT s_nationkey, max(s_acctbal) - min(s_acctbal) AS spread FROM supplier GROUP BY 1")
def u02(t: Tables) -> DataFrame:
    def spread(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_nationkey": [key[0]], "spread": [rows.s_acctbal.max() - rows.s_acctbal.min()]})

    return t.supplier.select("s_nationkey", "s_acctbal").groupBy("s_nationkey").applyInPandas(spread, "s_nationkey int, spread double")


@query("u02_grouped_agg", "SELECT s_nationkey, round(quantile_cont(s_acctbal, 0.5), 4) AS median FROM supplier GROUP BY 1")
def u02a(t: Tables) -> DataFrame:
    """An aggregate function of our own."""

    @F.pandas_udf("double")
    def median(values: pd.Series) -> float:
        return float(values.median())

    return t.supplier.groupBy("s_nationkey").agg(F.round(median("s_acctbal"), 4).alias("median"))


@query("u03_table_function", "SELECT r_regionkey, i FROM region, (SELECT unnest(range(0, 3)) AS i)")
def u03(t: Tables) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="i bigint")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    t.spark.udtf.register("count_to", Count)
    return t.view("region").sql("SELECT r_regionkey, i FROM region, LATERAL count_to(3)")


@query("u04_map_in_arrow", "SELECT o_orderkey, o_totalprice > 200000 AS large FROM orders")
def u04(t: Tables) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["o_orderkey"], pc.greater(b["o_totalprice"], 200000)], ["o_orderkey", "large"])

    return t.orders.select("o_orderkey", "o_totalprice").mapInArrow(run, "o_orderkey long, large boolean")


@query("u05_data_source", "SELECT i AS n, i * i AS square FROM (SELECT unnest(range(0, 100)) AS i)")
def u05(t: Tables) -> DataFrame:
    from evigraph.sources.squares import SquareSource

    t.spark.dataSource.register(SquareSource)
    return t.spark.read.format("squares").option("count", "100").load()
