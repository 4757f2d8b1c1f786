"""Stream operators, registered as batches and as streams over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.sources.shared import new_path
from evigraph.sources.tables import Tables
from evigraph.streaming import windows as sw

from .registry import query

_HOURLY = "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM {} GROUP BY 1, 2"
_SLIDING = """SELECT start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM (
SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS start, event_type, value FROM events) GROUP BY 1, 2"""
_SESSIONS = """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES, true))::INT AS new FROM events)) GROUP BY user_id, s"""
_PAIRS = """SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS
WHERE a.event_type = 'click' AND b.event_type = 'purchase'"""


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _drained(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until it is empty, into files of the shared folder."""
    return sw.run_once(stream, new_path(t.spark), mode)


@query("t01_tumbling", _HOURLY.format("events"))
def t01(t: Tables) -> DataFrame:
    return sw.tumbling(_events(t))


@query("t01_tumbling_stream", _HOURLY.format("events"))
def t01t(t: Tables) -> DataFrame:
    return _drained(t, sw.tumbling(sw.timed(_stream(t))), "complete")


@query("t01_sliding", _SLIDING)
def t01s(t: Tables) -> DataFrame:
    return sw.tumbling(_events(t), "2 hours", "1 hour")


@query("t01_sliding_stream", _SLIDING)
def t01ss(t: Tables) -> DataFrame:
    return _drained(t, sw.tumbling(sw.timed(_stream(t)), "2 hours", "1 hour"), "complete")


@query("t02_sessions", _SESSIONS)
def t02(t: Tables) -> DataFrame:
    return sw.sessions(_events(t))


@query("t02_sessions_stream", _SESSIONS)
def t02s(t: Tables) -> DataFrame:
    return _drained(t, sw.sessions(sw.timed(_stream(t))), "complete")


_ARRIVED = """(WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events WHERE event_id % 10 BETWEEN 1 AND 8)
SELECT e.* FROM events e, w WHERE event_id % 10 <> 0 OR date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR > mark)"""


@query("t03_watermark", _HOURLY.format(_ARRIVED))
def t03(t: Tables) -> DataFrame:
    """Every tenth event arrives after all others: those whose window the
    watermark has passed are dropped.

    A batch drops by the watermark that held when the one before it began to
    run, so it takes a batch in between.
    """
    folder, turn = new_path(t.spark), F.col("event_id") % 10
    for name, of in (("a", turn.between(1, 8)), ("b", turn == 9), ("c", turn == 0)):
        t.events.where(of).coalesce(1).write.parquet(f"{folder}/{name}")  # files are read by age
    schema = t.spark.read.parquet(f"{folder}/a").schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    counts = _drained(t, sw.tumbling(sw.timed(stream)), "update")
    return sw.latest(counts, ["start", "event_type"])


@query("t04_stateful", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def t04(t: Tables) -> DataFrame:
    """Running counts by user; the last update of each stands."""
    return sw.latest(_drained(t, sw.running_counts(_stream(t)), "update"), ["user_id"])


@query("t05_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def t05(t: Tables) -> DataFrame:
    return sw.deduplicated(_events(t).select("user_id", "event_type"), ["user_id", "event_type"])


@query("t05_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def t05s(t: Tables) -> DataFrame:
    kept = sw.deduplicated(sw.timed(_stream(t).select("ts", "user_id", "event_type"), "4000 days"), ["user_id", "event_type"])
    return _drained(t, kept.select("user_id", "event_type"), "append").drop("batch")


@query("t06_stream_join", _PAIRS)
def t06(t: Tables) -> DataFrame:
    e = _events(t)
    return sw.joined(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"))


@query("t06_streams_joined", _PAIRS)
def t06s(t: Tables) -> DataFrame:
    """Two streams with watermarks."""
    a, b = (sw.timed(_stream(t)).where(f"event_type = '{kind}'") for kind in ("click", "purchase"))
    return _drained(t, sw.joined(a, b), "append").drop("batch")


@query("t06_stream_static", "SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def t06t(t: Tables) -> DataFrame:
    """A stream with a table that doesn't change."""
    buys = _stream(t).where("event_type = 'purchase'")
    return _drained(t, buys.join(t.customer, F.col("c_custkey") == F.col("user_id")).select("event_id", "c_mktsegment"), "append").drop("batch")
