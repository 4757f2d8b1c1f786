r"""Quality rules: lines that recur across a host's documents, and counts within a text.

A line that many documents of one host share (navigation, notices, licence
texts) says nothing about any of them. Lines are normalised and hashed, the
distinct documents that hold a line are counted for each host, lines above the
limits are removed, and a document of which too little is left is rejected.

The hashes of a text's lines (128 bits each) are written once; counting, the
join with the frequent lines and the removed words need no text. Counts are
summed before each shuffle. The frequent lines are broadcast if they are few, and
else joined by line and a salt, so that a line of a third of all documents is
dealt over many tasks.

The counts within a text (``text_rules``) are array functions on the row: windows
are sorted with their places, equal neighbours are repeats, and the words that
those cover are counted by their distances. That takes n log n for n words, and
no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.bounds import fits

from ._common import as_table, documents

#: A line is removed if more of a host's documents have it than both limits.
MIN_DOCS = 20
SHARE = 0.005
#: A document that lost lines is rejected with fewer words or a smaller part left.
LEAST_WORDS = 20
LEAST_PART = 0.3
#: Frequent lines that are broadcast, and parts that others are dealt in.
MAX_LINES = 100_000
SALTS = 16

SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_WORDED = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
#: White space that isn't one blank, within a line.
_FOLDED = r"[\x20\x09\x0B-\x0D]+"
_UNFOLDED = r"\x20\x20|[\x09\x0B-\x0D]"
_LINES = "array<struct<a:bigint,b:bigint,words:int>>"
#: Bits of a place within a text.
_PLACE = 24


def _repeats(n: int) -> Column:
    """How many words are in windows of ``n`` words that occur twice or more,
    from ``p``, the ascending places where such windows begin."""
    reach = F.transform("p", lambda x, i: F.least(F.lit(n), F.coalesce(F.get("p", i + 1), x + n) - x))
    return F.aggregate(reach, F.lit(0), lambda s, x: s + x).cast("long")


def _beside(array: str, part: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Whether an element of a sorted array agrees with a neighbour in ``part``."""
    return lambda x, i: part(F.get(array, i - 1)).eqNullSafe(part(x)) | part(F.get(array, i + 1)).eqNullSafe(part(x))


def text_rules(docs: DataFrame, keep: list[str], text_col: str = "text", window: int = 3) -> DataFrame:
    """``keep`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``
    and ``base_failed`` of each whole text.

    Repeated windows are found by 40 bits of their hashes first, sorted as plain
    numbers with the place in the other 24, and then by their words. Texts of
    more words than 24 bits count are sorted by their words only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    count = lambda chars: (F.length("text") - F.length(reduce(lambda x, c: F.replace(x, F.lit(c)), chars, F.col("text")))).cast("long")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORDED))
    rows = rows.select(
        *keep, (F.length("text") - count(_SPACES)).alias("word_chars"), count(_SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.split("text", SPACE).alias("w"),
    )
    # only the first and the last piece can be empty
    begin = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    end = F.size("w") - F.when((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1).otherwise(0)
    own = ["word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(*keep, *own, "w", begin.alias("begin"), F.greatest(end - begin, F.lit(0)).alias("n"))
    at = lambda i: [F.get("w", F.col("begin") + i + k) for k in range(window)]
    every = F.when(F.col("n") >= window, F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    packed = F.sort_array(F.transform(every, lambda i: F.shiftleft(F.xxhash64(*at(i)), _PLACE) + i))
    small = F.col("n") < 2**_PLACE
    rows = rows.select(*keep, *own, "w", "begin", "n", F.when(small, packed).alias("h"))
    likely = F.transform(F.filter("h", _beside("h", lambda x: F.shiftright(x, _PLACE))), lambda x: x.bitwiseAND(F.lit(2**_PLACE - 1)).cast("int"))
    rows = rows.select(*keep, *own, "w", "begin", "n", F.when(small, likely).otherwise(every).alias("c"))
    grams = F.sort_array(F.transform("c", lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("i"))))
    rows = rows.select(*keep, *own, "n", grams.alias("s"))
    places = F.sort_array(F.transform(F.filter("s", _beside("s", lambda x: x["g"])), lambda x: x["i"]))
    rows = rows.select(*keep, *own, F.col("n").cast("long").alias("n_words"), places.alias("p"))
    rows = rows.select(*keep, *own, "n_words", _repeats(window).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _hashed(text: Column) -> Column:
    """128 bits and the words of each line that has a word, as structs ``a, b, words``.

    Lines are taken in lower case, with white space folded.
    """
    folded = F.when(text.rlike(_UNFOLDED), F.regexp_replace(text, _FOLDED, " ")).otherwise(text)
    lines = F.filter(F.transform(F.split(folded, "\n", -1), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), words(x).alias("words")))


def _host(column: str) -> Column:
    """The host's name; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def frequent_lines(rows: DataFrame, least: int, share: float) -> DataFrame:
    """``host, a, b``: lines in more than ``least`` documents of their host and in
    more than ``share`` of them. Equal texts are one document."""
    of_line = rows.select("host", "t", F.explode("hashed").alias("x")).select("host", "x.a", "x.b", "t")
    counts = of_line.groupBy("host", "a", "b").agg(F.countDistinct("t").alias("n")).where(F.col("n") > least)
    hosts = rows.groupBy("host").agg(F.countDistinct("t").alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > F.col("docs") * share).select("host", "a", "b")


def quality(
    docs: DataFrame, least: int = MIN_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, least_part: float = LEAST_PART,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_lines: int = MAX_LINES, salts: int = SALTS,
) -> DataFrame:
    """``doc_id``, the counts of ``text_rules``, ``n_removed_lines``, ``n_left_words``,
    ``depleted`` and ``kept`` for each row.

    A line is removed where it is in more than ``least`` distinct documents of
    the row's host and in more than ``share`` of that host's. Documents with
    equal texts count once: copies are not what makes a line frequent. A row
    that lost lines is depleted if fewer than ``least_words`` words are left, or
    less than ``least_part`` of its words. ``kept`` is false for depleted rows
    and for those that failed the counts.

    Null and empty texts have no lines and fail; a null host is a host of its
    own. Repeated rows and null ids keep their rows. Lines without a word are
    no lines. An empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), _host(host_col).alias("host"), text.alias("body"))
    named = named.select("doc_id", "host", "body", F.xxhash64("body").alias("t"), F.coalesce(_hashed(F.col("body")), F.array().cast(_LINES)).alias("hashed"))
    rows = text_rules(named, ["doc_id", "host", "t", "hashed"], "body")
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "t", "hashed", *counted)
    rows = as_table(rows)
    common = as_table(frequent_lines(rows, least, share))
    held = rows.select("row", "host", F.explode("hashed").alias("x")).select("row", "host", "x.*")
    if fits(common, max_lines):
        hits = held.join(F.broadcast(common), ["host", "a", "b"])
    else:
        dealt = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(dealt, ["host", "a", "b", "salt"])
    lost = hits.groupBy("row").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("lost"))
    found = rows.select("row", "doc_id", *counted).join(lost, "row", "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    found = found.select("doc_id", *counted, F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), left.alias("n_left_words"))
    short = (F.col("n_left_words") < least_words) | (F.col("n_left_words") < F.col("n_words") * least_part)
    found = found.withColumn("depleted", (F.col("n_removed_lines") > 0) & short)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_frequent_lines(
    docs: DataFrame, least: int = MIN_DOCS, share: float = SHARE, text_col: str = "text", host_col: str = "source", max_lines: int = MAX_LINES
) -> DataFrame:
    """``docs`` with the frequent lines cut out of its texts; other lines and the
    order stay, and texts without such lines stay as they are.

    Each distinct text's frequent lines are listed once and joined with the
    rows by host and text.
    """
    body, host = F.col(text_col).cast("string"), _host(host_col)
    split = F.split(body, "\n", -1)
    rows = as_table(docs.select(host.alias("host"), F.xxhash64(body).alias("t"), F.xxhash64(F.lit(1), body).alias("u"), _hashed(body).alias("hashed")).where("hashed IS NOT NULL"))
    common = as_table(frequent_lines(rows, least, share))
    held = rows.select("host", "t", "u", F.explode("hashed").alias("x")).select("host", "t", "u", "x.a", "x.b").distinct()
    hits = held.join(F.broadcast(common) if fits(common, max_lines) else common, ["host", "a", "b"])
    drop = hits.groupBy("host", "t", "u").agg(F.collect_set(F.struct("a", "b")).alias("gone")).toDF("_host", "_t", "_u", "_gone")
    own = docs.withColumns({"_host": host, "_t": F.xxhash64(body), "_u": F.xxhash64(F.lit(1), body)}).join(drop, ["_host", "_t", "_u"], "left")
    gone = lambda x: F.array_contains("_gone", F.struct(x["a"], x["b"]))
    kept = F.filter(split, lambda x: ~x.rlike(_WORDED) | ~gone(F.get(_hashed(x), F.lit(0))))
    cut = F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(body)
    return own.withColumn(text_col, cut).drop("_host", "_t", "_u", "_gone")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    return quality(documents(spark, sf_dir))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT row, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
p AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
r AS (SELECT row, sum(least(3, coalesce(nxt, i + 3) - i)) AS n_repeat FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM p) GROUP BY 1),
l AS (SELECT row, host, md5(text) AS t, line FROM (SELECT row, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY 1),
h AS (SELECT row, host, t, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM h GROUP BY 1, 2) JOIN (SELECT host, count(DISTINCT md5(text)) AS docs FROM d GROUP BY 1) USING (host)
  WHERE n > {MIN_DOCS} AND n > docs * {SHARE}),
x AS (SELECT row, count(*) AS gone, sum(words) AS lost FROM h JOIN f USING (host, line) GROUP BY 1),
c AS (SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_lines, (len(w) - coalesce(lost, 0))::BIGINT AS n_left_words
  FROM d JOIN w USING (row) LEFT JOIN r USING (row) LEFT JOIN u USING (row) LEFT JOIN x USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_removed_lines > 0 AND (n_left_words < {LEAST_WORDS} OR n_left_words < n_words * {LEAST_PART}) AS depleted FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_left_words, depleted, NOT base_failed AND NOT depleted AS kept FROM b
"""
