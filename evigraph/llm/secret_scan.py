r"""Secret scanning with linked multipart credentials.

Strong spans are found by three patterns. Weak candidates (named identifiers,
long mixed tokens and endpoints) are common in harmless text, so they are
reported only where complementary parts co-occur: spans are joined by interval,
and a weak identifier needs a secret in its scope, a weak secret an identifier,
and an endpoint both, or one of them that has the other in its scope. The scope of a span is its interval and ``SCOPE`` code
points to either side, so a long part doesn't push its complement away.

Positions come from splitting a text at a pattern: the pieces and the matches
alternate, so the running sum of their lengths tells where each match ends. The
interval joins are sweeps over the spans of a document. Of all spans that begin
up to some point, one reaches an interval that ends there if the largest end
does, so a running maximum of ends in order of starts answers whether an
interval is met. That makes no pairs, takes time in proportion to the matches
(and their sort), and the texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents

SCOPE = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_IDS = "|".join(_either_case(w) for w in ("client", "account", "user", "key"))

#: Kinds in the order in which ties are listed: pattern, group whose length counts, and that length.
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("weak_id", rf"""({_IDS})[_-]?[iI][dD]["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.-]+)""", 2, 4),
    ("weak_secret", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""", 0, 8),
]
KINDS = [k for k, *_ in STRONG + WEAK]


def _pieces(text: str, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for the leftmost matches that don't overlap: their number, the lengths
    of the piece before and of the match, and whether they are long enough."""
    regex = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = f"arrays_zip(regexp_extract_all({text}, {regex}, 0), regexp_extract_all({text}, {regex}, {group}), split({text}, {regex}, -1))"
    piece = f"named_struct('k', {KINDS.index(kind)}, 'i', i, 'before', length(x.`2`), 'own', length(x.`0`), 'ok', length(x.`1`) >= {least})"
    found = f"transform(filter({parts}, x -> x.`0` IS NOT NULL), (x, i) -> {piece})"
    return f"if({text} RLIKE {regex}, {found}, cast(array() AS {_PIECES}))"


_PIECES = "array<struct<k:int,i:int,before:int,own:int,ok:boolean>>"


def _reached(spans: DataFrame, begin: Column, reach: Column, ends: dict[str, Column]) -> DataFrame:
    """``spans`` with, for each name, the largest of its ``ends`` among the spans
    of the document that begin (``begin``) at or before ``reach``."""
    entry = F.struct(begin.alias("at"), F.lit(0).alias("asks"), *[v.alias(n) for n, v in ends.items()])
    query = F.struct(reach.alias("at"), F.lit(1).alias("asks"), *[F.lit(None).cast("int").alias(n) for n in ends])
    events = spans.withColumn("event", F.explode(F.array(entry, query)))
    so_far = Window.partitionBy("row").orderBy("event.at", "event.asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    largest = {n: F.max(f"event.{n}").over(so_far) for n in ends}
    return events.withColumns(largest).where("event.asks = 1").drop("event")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for each row: ``spans`` is an array of (start, kind, end).

    Positions are code points, the end exclusive; spans are in order of start
    and kind. Weak spans that overlap a strong one are left out.

    Null and empty texts have no spans. Each row is scanned by itself, so
    repeated rows and null ids keep their rows; an empty table gives none.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text)
    always = ", ".join(_pieces("text", *kind) for kind in [*STRONG, WEAK[0]])
    rest = ", ".join(_pieces("text", *kind) for kind in WEAK[1:])
    # without an identifier in the text no weak part has its complement
    names = " OR ".join("text RLIKE '" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in (STRONG[1][1], WEAK[0][1]))
    none = "array(named_struct('k', -1, 'i', 0, 'before', 0, 'own', 0, 'ok', true))"  # keeps the row
    found = f"explode(concat({none}, {always}, if({names}, concat({rest}), cast(array() AS {_PIECES})))) AS x"
    pieces = rows.selectExpr("doc_id", "row", found).select("doc_id", "row", "x.*").repartition("row")
    until = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = pieces.withColumn("e", F.sum(F.col("before") + F.col("own")).over(until).cast("int")).where("ok")
    k = F.col("k")
    spans = spans.select("doc_id", "row", "k", (F.col("e") - F.col("own")).alias("s"), "e")
    strong = (k >= 0) & (k < len(STRONG))
    spans = _reached(spans, F.col("s"), F.col("e") - 1, {"strong": F.when(strong, F.col("e"))})
    spans = spans.where((k < len(STRONG)) | F.col("strong").isNull() | (F.col("strong") <= F.col("s"))).drop("strong")
    of = lambda *kinds: F.when(k.isin([KINDS.index(x) for x in kinds]), F.col("e"))
    ends = {"id_end": of("access", "weak_id"), "secret_end": of("assign", "hex", "weak_secret")}
    spans = _reached(spans, F.col("s"), F.col("e") + scope, ends)
    has = lambda name: F.coalesce(F.col(name) >= F.col("s") - scope, F.lit(False))
    spans = spans.select("doc_id", "row", "k", "s", "e", has("id_end").alias("has_id"), has("secret_end").alias("has_secret"))
    paired = (of("access", "weak_id").isNotNull() & F.col("has_secret")) | (of("assign", "hex", "weak_secret").isNotNull() & F.col("has_id"))
    spans = _reached(spans, F.col("s"), F.col("e") + scope, {"pair_end": F.when(paired, F.col("e"))})
    both = (F.col("has_id") & F.col("has_secret")) | has("pair_end")
    complement = {"weak_id": F.col("has_secret"), "weak_secret": F.col("has_id"), "endpoint": both}
    linked = strong
    for kind, met in complement.items():
        linked = linked | ((k == KINDS.index(kind)) & met)
    kept = F.when(linked, F.struct("s", "k", "e"))
    whole = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(kept)).alias("spans"))
    return whole.select("doc_id", "spans")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda n: F.size(F.filter("spans", lambda x: x["k"] == n)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < len(STRONG))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same as SQL: pieces and matches are numbered and their lengths summed."""
    parts = []
    for number, (kind, pattern, group, least) in enumerate(STRONG + WEAK):
        regex = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
m{number} AS (
  SELECT doc_id, s, s + length(m) AS e, {number} AS k FROM (
    SELECT doc_id, m, g, (sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s
    FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS p FROM (
      SELECT doc_id, regexp_extract_all(text, {regex}) AS ms, regexp_extract_all(text, {regex}, {group}) AS gs, regexp_split_to_array(text, {regex}) AS ps FROM documents))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE length(g) >= {least}
)""")
    strong = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(len(STRONG)))
    weak = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(len(STRONG), len(KINDS)))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return "WITH" + ",".join(parts) + f""",
strong AS ({strong}), weak AS ({weak}),
sp AS (SELECT * FROM strong UNION ALL SELECT * FROM weak w WHERE NOT EXISTS (SELECT 1 FROM strong x WHERE x.doc_id = w.doc_id AND x.s < w.e AND x.e > w.s)),
n AS (SELECT *,
  EXISTS (SELECT 1 FROM sp x WHERE x.doc_id = w.doc_id AND x.k IN (1, 3) AND x.s <= w.e + {SCOPE} AND x.e >= w.s - {SCOPE}) AS has_id,
  EXISTS (SELECT 1 FROM sp x WHERE x.doc_id = w.doc_id AND x.k IN (0, 2, 4) AND x.s <= w.e + {SCOPE} AND x.e >= w.s - {SCOPE}) AS has_secret
  FROM sp w),
r AS (SELECT doc_id, s, e, k FROM n WHERE k < 3 OR (k = 3 AND has_secret) OR (k = 4 AND has_id) OR (k = 5 AND (has_id AND has_secret OR EXISTS (
  SELECT 1 FROM n x WHERE x.doc_id = n.doc_id AND x.s <= n.e + {SCOPE} AND x.e >= n.s - {SCOPE} AND (x.k IN (1, 3) AND x.has_secret OR x.k IN (0, 2, 4) AND x.has_id))))),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
  {listed} FILTER (WHERE k < 3) AS base, {listed} AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)"""


OP7_SQL = _sql()
