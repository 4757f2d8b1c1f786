"""Retrieval, extraction and answer scores, and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def evidence_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query: its gold documents, those found, their share, and whether all are."""
    found = gold.join(hits.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("n_found"))
    return per.withColumns({"recall": F.round(F.col("n_found") / F.col("n_gold"), 6), "complete": (F.col("n_found") == F.col("n_gold")).cast("long")})


def full_evidence_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """The mean share found, and the share of queries with all of it found."""
    return evidence_recall(hits, gold).agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("complete"), 6).alias("complete_recall"))


def eval_subset(per_query: DataFrame, core: DataFrame) -> DataFrame:
    """Mean recall over the core queries."""
    return per_query.join(core, "query_id", "left_semi").agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def prf(predicted: DataFrame, gold: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Precision, recall and F1 of key sets for each value of ``by``."""
    p = predicted.select(by, *keys).distinct().withColumn("p", F.lit(1))
    g = gold.select(by, *keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, [by, *keys], "full").groupBy(by).agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("n_right"))
    pr, re = F.try_divide("n_right", "n_pred"), F.try_divide("n_right", "n_gold")
    return both.select(by, F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(F.try_divide(2 * F.col("n_right"), F.col("n_pred") + F.col("n_gold")), 6).alias("f1"))


def rank_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """MRR, precision@k and nDCG@k over the gold's queries."""
    marked = hits.where(F.col("rank") <= k).join(gold.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    per = marked.groupBy("query_id").agg(F.max(F.col("rel") / F.col("rank")).alias("rr"), (F.sum("rel") / k).alias("pk"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = gold.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    all_ = ideal.join(per, "query_id", "left").fillna(0.0, ["rr", "pk", "dcg"])
    return all_.agg(F.count("*").alias("n_queries"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("pk"), 6).alias("precision_at_k"), F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def model_mean(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))


def compare(runs: DataFrame, configs: list[str]) -> DataFrame:
    """Metrics by rows, configurations by columns."""
    return runs.groupBy("metric").pivot("config", configs).agg(F.round(F.avg("value"), 6))


def check_consistency(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, copies counted."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def qa_scores(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, value`` of the gold's queries: 2 if the first hit is gold, 1 if
    another one is, 0 if none."""
    marked = gold.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    best = marked.groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.select("query_id", F.when(F.col("best") == 1, 2.0).when(F.col("best") > 1, 1.0).otherwise(0.0).alias("value"))


def sys_metrics(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` observed: metrics are gathered while it runs, without another pass.

    What was seen is in the observation once the frame has run.
    """
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def measured(df: DataFrame, name: str, **metrics) -> DataFrame:
    """Run ``df`` and return what was observed: ``metric, value``."""
    observed, seen = sys_metrics(df, name, **metrics)
    observed.write.format("noop").mode("overwrite").save()
    rows = [(k, None if v is None else float(v)) for k, v in seen.get.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


#: Bounds of a uniform number between the values of a Poisson variable of mean one.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)


def paired_bootstrap(scores: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """``n_queries, gain, low, high``: the mean of ``b - a`` and its interval.

    ``scores`` has ``query_id, a, b``. In each replicate every query has a weight,
    a Poisson number made from a hash of both, so both scores of a query are
    drawn together, tasks need no common generator, and repeated runs are equal.
    Queries with a missing score are left out.
    """
    used = scores.where("a IS NOT NULL AND b IS NOT NULL").select("query_id", (F.col("b") - F.col("a")).alias("d"))
    drawn = used.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    hashed = F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("replicate").cast("string")))
    u = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / 2.0**32
    weight = sum((F.when(u >= bound, 1.0).otherwise(0.0) for bound in POISSON), F.lit(0.0))
    means = drawn.withColumn("w", weight).groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("gain"))
    side = (1 - level) / 2
    bounds = means.agg(F.round(F.percentile("gain", side), 6).alias("low"), F.round(F.percentile("gain", 1 - side), 6).alias("high"))
    return used.agg(F.count("*").alias("n_queries"), F.round(F.avg("d"), 6).alias("gain")).crossJoin(bounds)  # a row each
