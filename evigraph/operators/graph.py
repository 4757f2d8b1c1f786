"""Building, checking and walking the event graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.bounds import dealt
from evigraph.sources.shared import as_table
from evigraph.sources.tables import Graph, Tables

NODE_TYPES = ("region", "nation", "customer", "supplier", "part", "order")
RELATIONS = ("nation_in_region", "customer_in_nation", "supplier_in_nation", "order_of_customer", "order_has_part", "part_from_supplier")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def build_graph(t: Tables) -> Graph:
    """The star schema as a typed graph; edges carry a time where the rows do.

    Distinct edges are found in partitions of a bounded number of rows.
    """
    nodes = [
        t.region.select(_id("r", "r_regionkey"), F.lit("region"), "r_name"), t.nation.select(_id("n", "n_nationkey"), F.lit("nation"), "n_name"),
        t.customer.select(_id("c", "c_custkey"), F.lit("customer"), "c_name"), t.supplier.select(_id("s", "s_suppkey"), F.lit("supplier"), "s_name"),
        t.part.select(_id("p", "p_partkey"), F.lit("part"), "p_name"), t.orders.select(_id("o", "o_orderkey"), F.lit("order"), F.col("o_orderkey").cast("string")),
    ]
    none = F.lit(None).cast("date")
    rows = t.lineitem.count()
    order_time = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    in_order = dealt(t.lineitem.select("l_orderkey", "l_partkey"), rows, "l_orderkey").distinct().join(order_time, "l_orderkey")
    supplied = dealt(t.lineitem.select("l_partkey", "l_suppkey"), rows, "l_partkey", "l_suppkey").distinct()
    edges = [
        t.nation.select(_id("n", "n_nationkey"), _id("r", "n_regionkey"), F.lit(RELATIONS[0]), none), t.customer.select(_id("c", "c_custkey"), _id("n", "c_nationkey"), F.lit(RELATIONS[1]), none),
        t.supplier.select(_id("s", "s_suppkey"), _id("n", "s_nationkey"), F.lit(RELATIONS[2]), none), t.orders.select(_id("o", "o_orderkey"), _id("c", "o_custkey"), F.lit(RELATIONS[3]), F.to_date("o_orderdate")),
        in_order.select(_id("o", "l_orderkey"), _id("p", "l_partkey"), F.lit(RELATIONS[4]), "day"), supplied.select(_id("p", "l_partkey"), _id("s", "l_suppkey"), F.lit(RELATIONS[5]), none),
    ]
    union = lambda parts, names: parts[0].toDF(*names) if len(parts) == 1 else parts[0].toDF(*names).unionByName(union(parts[1:], names))
    return Graph(union(nodes, ["node_id", "node_type", "name"]), union(edges, ["src", "dst", "rel", "valid_time"]))


def graph_stats(g: Graph) -> DataFrame:
    """Counts by node type and by relation."""
    nodes = g.nodes.groupBy(F.lit("node").alias("part"), F.col("node_type").alias("kind")).count()
    edges = g.edges.groupBy(F.lit("edge").alias("part"), F.col("rel").alias("kind")).count()
    return nodes.unionByName(edges).withColumnRenamed("count", "n")


def lookup(g: Graph, *ids: str) -> DataFrame:
    return g.nodes.where(F.col("node_id").isin(*ids))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """``at, to, rel, valid_time``: edges as they are walked."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "rel", "valid_time")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "rel", "valid_time")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(g: Graph, ids: list[str], rel: str | None = None, direction: str = "both") -> DataFrame:
    """``at, to, rel`` one hop from the ids; the filter reaches the scans."""
    walked = _directed(g.edges if rel is None else g.edges.where(F.col("rel") == rel), direction)
    return walked.where(F.col("at").isin(*ids)).select("at", "to", "rel").distinct()


def expand(
    g: Graph, ids: list[str], max_hops: int, low: str | None = None, high: str | None = None, direction: str = "both", rels: list[str] | None = None
) -> DataFrame:
    """``node_id, hops``: what is reached and in how few hops.

    With ``low`` or ``high``, edges with a time outside the range aren't walked;
    edges without a time always are. Each hop's front is a table of distinct
    nodes, so paths don't multiply and each hop reads the edges once; the walk
    ends where nothing new is reached.
    """
    edges = g.edges if rels is None else g.edges.where(F.col("rel").isin(*rels))
    for bound, keep in ((low, F.col("valid_time") >= F.lit(low)), (high, F.col("valid_time") <= F.lit(high))):
        if bound is not None:
            edges = edges.where(F.col("valid_time").isNull() | keep)
    walked = _directed(edges, direction).select("at", "to")
    front = as_table(lookup(g, *ids).select("node_id", F.lit(0).alias("hops")))
    reached = front
    for hop in range(1, max_hops + 1):
        near = front.join(walked, F.col("node_id") == F.col("at")).select(F.col("to").alias("node_id"), F.lit(hop).alias("hops")).distinct()
        front = as_table(near.join(reached, "node_id", "left_anti").select("node_id", "hops"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def earliest_arrival(g: Graph, ids: list[str], max_hops: int, start: str = "1900-01-01", direction: str = "out") -> DataFrame:
    """``node_id, arrival``: when each node is reached first by a path whose edges'
    times don't go back, from the ids at ``start``, in at most ``max_hops`` hops.

    An edge is walked at its time, which must not be before the arrival at its
    near end; an edge without a time is walked at once. Labels are corrected
    hop by hop: a node is walked from again when its arrival was lowered.
    Minima are taken before the shuffle; labels and fronts are tables.
    """
    walked = _directed(g.edges, direction).select("at", "to", "valid_time")
    labels = as_table(lookup(g, *ids).select("node_id", F.lit(start).cast("date").alias("arrival")).distinct())
    front = labels
    for _ in range(max_hops):
        near = front.join(walked, F.col("node_id") == F.col("at")).where("valid_time IS NULL OR valid_time >= arrival")
        near = near.groupBy("to").agg(F.min(F.coalesce("valid_time", "arrival")).alias("new"))
        both = labels.join(near, F.col("node_id") == F.col("to"), "full")
        both = both.select(F.coalesce("node_id", "to").alias("node_id"), F.least("arrival", "new").alias("arrival"), (F.col("arrival").isNull() | (F.col("new") < F.col("arrival"))).alias("lower"))
        both = as_table(both)
        labels, front = both.select("node_id", "arrival"), both.where("lower").select("node_id", "arrival")
        if front.isEmpty():
            break
    return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: the smallest id that each node is connected with.

    In each round every node takes the smallest label next to it and then the
    label of that label, so paths halve; rounds end when nothing changes. Labels
    are tables; minima are taken before the shuffle, so hubs are no large group.
    """
    both = _directed(edges.select("src", "dst", F.lit("").alias("rel"), F.lit(None).alias("valid_time")), "both").select("at", "to").distinct()
    both = as_table(both.where(F.col("at") != F.col("to")))
    labels = as_table(nodes.select("node_id", F.col("node_id").alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("to") == F.col("node_id")).groupBy("at").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node_id") == F.col("at"), "left").select("node_id", "component", F.least("component", "near").alias("next"))
        lower = as_table(lower)
        above = lower.select(F.col("node_id").alias("next"), F.col("next").alias("above"))
        moved = as_table(lower.join(above, "next", "left").select("node_id", "component", F.least("next", "above").alias("new")))
        labels = moved.select("node_id", F.col("new").alias("component"))
        if moved.where("new <> component").isEmpty():
            return labels


def page_rank(g: Graph, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``node_id, rank``: PageRank over directed edges, the sum being one.

    The rank of nodes without an edge out is shared by all. Nodes that no edge
    leads to have one rank in each round, the same for all of them: what they pass
    on is summed once, and a round reads the other edges and the nodes that are
    led to. Each edge is dealt by its source once.
    """
    ids = as_table(g.nodes.select("node_id").distinct())
    n = max(ids.count(), 1)
    edges = as_table(g.edges.select("src", "dst"))
    led_to = as_table(edges.select(F.col("dst").alias("node_id")).distinct().join(ids, "node_id", "left_semi"))
    marks = led_to.select(F.col("node_id").alias("src"), F.lit(True).alias("known"), F.lit(True).alias("led"))
    marks = marks.unionByName(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("known"), F.lit(False).alias("led")))
    links = edges.withColumns({"known": F.lit(False), "led": F.lit(False)}).unionByName(marks.withColumn("dst", F.lit(None).cast("string")))
    links = dealt(links.where("src IS NOT NULL"), edges.count() + n, "src").dropDuplicates(["src", "dst", "known", "led"])
    of_source = Window.partitionBy("src")
    whole = {"n_out": F.count_if(~F.col("known")).over(of_source), "of_known": F.max("known").over(of_source), "of_led": F.max("led").over(of_source)}
    links = links.withColumns(whole).where("NOT known AND of_known AND dst IS NOT NULL")
    links = as_table(links.select("src", "dst", (F.lit(1.0) / F.col("n_out")).alias("part"), F.col("of_led").alias("led")))
    once = links.where("NOT led").groupBy(F.col("dst").alias("node_id")).agg(F.sum("part").alias("once"))
    into = as_table(led_to.join(once, "node_id", "left").select("node_id", F.coalesce("once", F.lit(0.0)).alias("once")))
    again = links.where("led").select("src", "dst", "part")
    ranks, least = into.select("node_id", F.lit(1.0 / n).alias("rank")), 1.0 / n
    for _ in range(rounds):
        passed = ranks.join(again, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("more"))
        got = F.col("once") * least + F.coalesce("more", F.lit(0.0))
        held = as_table(into.join(passed, F.col("node_id") == F.col("dst"), "left").select("node_id", got.alias("got")))
        lost = 1 - (held.agg(F.sum("got").alias("s")).first()["s"] or 0.0)
        least = (1 - damping + damping * lost) / n
        ranks = held.select("node_id", (least + damping * F.col("got")).alias("rank"))
    return ids.join(ranks, "node_id", "left").select("node_id", F.coalesce("rank", F.lit(least)).alias("rank"))


def common_neighbors(g: Graph, ids: list[str], direction: str = "both") -> DataFrame:
    """Nodes next to all of the ids."""
    near = neighbors(g, ids, direction=direction).groupBy("to").agg(F.countDistinct("at").alias("n"))
    return near.where(F.col("n") == len(set(ids))).select(F.col("to").alias("node_id"))


def paths(g: Graph, start: str, goal: str, max_hops: int, direction: str = "both") -> DataFrame:
    """``path, hops``: simple paths from start to goal.

    Repeated edges are dropped where they were walked, so each hop reads the
    edges once and groups its paths only, which are a table.
    """
    walked = _directed(g.edges, direction).select("at", "to")
    front = as_table(lookup(g, start).select(F.col("node_id").alias("end"), F.array("node_id").alias("path")))
    found = []
    for hop in range(1, max_hops + 1):
        near = front.join(walked, F.col("end") == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(F.col("to").alias("end"), F.array_append("path", F.col("to")).alias("path"))
        near = as_table(near.distinct())
        found.append(near.where(F.col("end") == goal).select(F.array_join("path", ">").alias("path"), F.lit(hop).alias("hops")))
        front = near.where(F.col("end") != goal)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def subgraph(g: Graph, ids: list[str], hops: int) -> DataFrame:
    """Edges whose ends are both reached."""
    near = expand(g, ids, hops).select("node_id")
    return g.edges.join(near.withColumnRenamed("node_id", "src"), "src", "left_semi").join(near.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "rel")


def edge_evidence(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the chunks of their evidence document."""
    return edges.join(chunks, F.col("evidence_doc") == F.col("doc_id")).select("src", "dst", "rel", "doc_id", "chunk_no")


def validate_graph(g: Graph) -> DataFrame:
    """``check_name, violations``: ends that are missing, kinds that are unknown, repeats.

    Edges are counted by each end before they meet the nodes, so no edge is sorted
    for a join and a hub is one row.
    """
    nodes = g.nodes.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False))).alias("odd"))
    of_nodes = nodes.agg(F.sum("odd").alias("unknown_type"), F.count_if(F.col("n") > 1).alias("repeated_node"))
    known = g.nodes.select("node_id")
    missing = lambda end: g.edges.groupBy(F.col(end).alias("node_id")).agg(F.count("*").alias("n")).join(known, "node_id", "left_anti").agg(F.sum("n").alias(f"missing_{end}"))
    kinds = g.edges.agg(
        F.count_if(~F.coalesce(F.col("rel").isin(*RELATIONS), F.lit(False))).alias("unknown_relation"), F.count_if(F.col("src") == F.col("dst")).alias("self_loop")
    )
    repeated = dealt(g.edges, g.edges.count(), "src", "dst", "rel").groupBy("src", "dst", "rel").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_edge"))
    long = lambda df: df.unpivot([], df.columns, "check_name", "violations").select("check_name", F.coalesce("violations", F.lit(0)).alias("violations"))
    return reduce(DataFrame.unionByName, map(long, (of_nodes, missing("src"), missing("dst"), kinds, repeated)))


def degree(g: Graph) -> DataFrame:
    """``node_id, n_out, n_in`` of nodes that have edges."""
    ends = g.edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
