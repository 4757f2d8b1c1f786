"""Line-level deduplication by a suffix array over sequences of line ids.

Every line that occurs twice or more gets a position: lines of a document follow
each other, and a line that is unique or has no word is a gap, so a *stretch* is
a run of consecutive positions. The suffixes of the stretches are ranked by
distributed prefix doubling: the rank of a window of ``2k`` lines is that of the
pair (rank of its first ``k`` lines, rank of the next ``k``), counted as one plus
the number of windows that sort before it. A rank is therefore the first index
of the window's interval in the suffix array. Doubling ends when no interval is
split any more; stretches without a repeated window leave it earlier.

The nested intervals of one rank at each length are the intervals of a common
prefix. For each suffix the deepest interval is wanted in which another suffix
has an earlier position: its depth is the longest run of lines from here that
has an earlier copy. The doubled lengths give it to the power of two; the lines
beyond are found by halving: within an interval, the first position of each
sub-interval half as much deeper stays, and the others go down. Only minima and
counts by (interval, rank) and joins on them are used, so a very common line or
passage is no large group.

A run is maximal if it isn't the tail of the run that starts one line before.
Each run that is deleted occurs as a whole at an earlier position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, as_table, documents

KEY = ["kn", "kd", "kt"]
#: A longest copy that lasts to the end of its stretch.
TO_END = 2**62
#: Widths of the buckets in which ranks are counted, as bits.
RANK_BITS, HASH_BITS = 16, 52


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with the key that orders them: null ids last, then the id.

    Rows of the same id and text are the same document.
    """
    ident = F.col(id_col)
    return docs.select(
        "*",
        ident.isNull().alias("kn"),
        F.coalesce(ident.cast("long"), F.lit(0).cast("long")).alias("kd"),
        F.xxhash64(F.col(text_col)).alias("kt"),
    )


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def line_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``kn, kd, kt, no, h1, h2, words`` for each line that has a word.

    ``h1`` and ``h2`` are the line's id: two hashes of which neither is made
    from the other, as the second reads the line shifted by a byte.
    """
    line = F.col("line")
    return (
        docs.select(*KEY, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line"))
        .select(
            *KEY, "no", F.xxhash64(line).alias("h1"),
            F.xxhash64(F.concat(F.lit("|"), line)).alias("h2"), _words(line).alias("words"),
        )
        .where("words > 0")
    )


def _before(value: str, window) -> Column:
    """The sum of ``value`` over the earlier rows of the window."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("long"))


def _counted_ranks(counts: DataFrame, group: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """``counts`` with ``less``: the sum of ``n`` over the rows of the group that
    come before.

    Sums are taken in buckets of the first key first, so that no task counts
    through a whole group.
    """
    split = counts.withColumn("bucket", bucket)
    totals = split.groupBy(*group, "bucket").agg(F.sum("n").alias("total"))
    of_buckets = totals.select(*group, "bucket", _before("total", Window.partitionBy(*group).orderBy("bucket")).alias("base"))
    inside = split.withColumn("inside", _before("n", Window.partitionBy(*group, "bucket").orderBy(*order)))
    summed = inside.join(of_buckets, [*group, "bucket"])
    return summed.withColumn("less", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def place_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated lines as ``doc, pos, stretch, words, h1, h2`` and the
    documents with any as ``kn, kd, kt, doc``.

    ``doc`` is the position of a document's first line; positions follow the
    order of documents and lines.
    """
    repeated = as_table(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    active = as_table(lines.join(repeated, ["h1", "h2"]))
    docs = active.groupBy(*KEY).agg((F.max("no") + 2).cast("long").alias("n"))
    docs = as_table(as_table(docs).repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    ends = as_table(docs.groupBy("part").agg(F.sum("n").alias("total")))  # a row for each partition
    offsets = ends.select("part", _before("total", Window.orderBy("part")).alias("base"))
    inside = docs.withColumn("inside", _before("n", Window.partitionBy("part").orderBy(*KEY)))
    docs = as_table(inside.join(offsets, "part").select(*KEY, (F.col("base") + F.col("inside")).alias("doc")))
    at = active.join(docs, KEY).groupBy("doc", (F.col("doc") + F.col("no")).alias("pos"))  # repeated rows are one
    placed = at.agg(*[F.min(c).alias(c) for c in ("words", "h1", "h2")])
    in_doc = Window.partitionBy("doc").orderBy("pos")
    placed = placed.withColumn("stretch", F.col("pos") - F.row_number().over(in_doc))
    return as_table(placed.withColumn("end", F.max("pos").over(Window.partitionBy("doc", "stretch")) + 1)), docs


def _names(pairs: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """The distinct windows named by ``a, b`` with their rank.

    ``n`` is the size of the interval and ``first`` its first position.
    """
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    start = F.col("a") if group else F.lit(1).cast("long")
    counted = _counted_ranks(counts, group, bucket, ["a", "b"])
    return as_table(counted.withColumn("rank", start + F.col("less")).drop("less"))


def suffix_ranks(placed: DataFrame) -> list[DataFrame]:
    """Ranks of the windows of 1, 2, 4, ... lines: ``pos, stretch, end, rank, n, first``.

    Windows are cut off at the end of their stretch. A level leaves out the
    stretches whose windows were all unique or went beyond the end on the level
    before; levels after the first have that level's ``n0, first0`` as well. No
    interval of the last level is split by longer windows.
    """
    own = ["pos", "stretch", "end"]
    pairs = placed.select(*own, F.col("h1").alias("a"), F.col("h2").alias("b"))
    names = _names(pairs, [], F.shiftright("a", HASH_BITS))
    levels = [as_table(pairs.join(names, ["a", "b"]).drop("a", "b"))]
    width = 1
    while True:
        stretch = Window.partitionBy("stretch")
        follow = F.coalesce(F.lead("rank", width).over(stretch.orderBy("pos")), F.lit(0).cast("long"))
        open_ = (F.col("n") > 1) & (F.col("pos") + width <= F.col("end"))
        pairs = levels[-1].select(
            *own, F.col("rank").alias("a"), follow.alias("b"),
            F.col("n").alias("n0"), F.col("first").alias("first0"), F.max(open_).over(stretch).alias("open"),
        ).where("open").drop("open")
        names = _names(pairs, ["a"], F.shiftright("b", RANK_BITS))
        if not names.where("rank <> a").limit(1).count():
            return levels
        levels.append(as_table(pairs.join(names, ["a", "b"]).drop("a", "b")))
        width *= 2


def longest_copies(levels: list[DataFrame]) -> DataFrame:
    """``pos, lines`` for each position whose line has an earlier copy.

    ``lines`` is the length of the longest run of lines from there that occurs
    at an earlier position as well, ``TO_END`` if it is the rest of the stretch.
    """
    # Rows (pos, first, lines): the window of so many lines at pos is in the
    # interval whose first position is first. Where the two are equal, pos is
    # only there for others to be compared with.
    rest = F.col("end") - F.col("pos")
    found = None
    for i in range(len(levels) - 2, -1, -1):
        upper = levels[i + 1].where((F.col("n0") > F.col("n")) & (F.col("first") == F.col("pos")) & (rest >= 1 << i))
        added = upper.select("pos", F.col("first0").alias("first"), F.lit(1 << i).cast("long").alias("lines"))
        if found is not None:
            half = levels[i].select(F.col("pos").alias("at"), F.col("rank").alias("next"))
            known = found.withColumn("at", F.col("pos") + F.col("lines")).join(half, "at", "left")
            known = known.select("pos", "first", "lines", F.coalesce("next", F.lit(0).cast("long")).alias("next"))
            deeper = known.groupBy("first", "lines", "next").agg(F.min("pos").alias("head"), F.count("*").alias("n"))
            both = known.join(deeper, ["first", "lines", "next"])
            entry = "struct<pos:bigint,first:bigint,lines:bigint>"
            stays = F.when(F.col("pos") == F.col("head"), F.struct("pos", "first", "lines").cast(entry))
            longer = (F.col("lines") + (1 << i)).alias("lines")
            goes = F.when(F.col("n") > 1, F.struct("pos", F.col("head").alias("first"), longer).cast(entry))
            added = as_table(both.select(F.inline(F.array_compact(F.array(stays, goes))))).unionByName(added)
        found = added
    ended = []
    for i, level in enumerate(levels):
        here = (rest < 1 << i) & (rest >= (1 << i) // 2)
        if i == len(levels) - 1:
            here |= rest >= 1 << i
        ended.append(level.where(here & (F.col("first") != F.col("pos"))).select("pos", F.lit(TO_END).cast("long").alias("lines")))
    out = ended[0]
    for part in [*ended[1:], *([found.where("first <> pos").select("pos", "lines")] if found is not None else [])]:
        out = out.unionByName(part)
    return out


def _cuts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """From a document's repeated lines and longest copies to the lines to delete."""
    names = ["doc", "cut", "n_cut", "n_runs", "longest_run"]
    for batch in batches:
        size = batch.num_rows
        column = batch["found"]
        counts = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        no, words, lines, stretch = (flat.field(c).to_numpy() for c in ("no", "words", "lines", "stretch"))
        row, index = np.repeat(np.arange(size), counts), np.arange(len(no))
        last = np.flatnonzero(np.r_[stretch[1:] != stretch[:-1], True]) if len(no) else np.zeros(0, int)
        end = last[np.searchsorted(last, index)] + 1
        lines = np.minimum(lines, end - index)
        inner = np.r_[False, stretch[1:] == stretch[:-1]] if len(no) else np.zeros(0, bool)
        begins = (lines > 0) & ~(inner & (np.r_[0, lines[:-1]] - 1 >= lines))
        total = np.r_[0, np.cumsum(words, dtype=np.int64)]
        begins &= total[index + lines] - total[index] >= min_words
        gone = np.maximum.accumulate(np.where(begins, index + lines, 0)) > index if len(no) else np.zeros(0, bool)
        longest = np.zeros(size, np.int64)
        np.maximum.at(longest, row, lines)
        width = np.zeros(size, np.int64)
        np.maximum.at(width, row[gone], no[gone] + 1)
        offset = np.r_[0, np.cumsum(width)]
        cut = np.zeros(offset[-1], bool)
        cut[offset[row[gone]] + no[gone]] = True
        lists = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(cut))
        n_cut, n_runs = np.bincount(row[gone], minlength=size), np.bincount(row[begins], minlength=size)
        columns = [batch["doc"], lists, pa.array(n_cut.astype(np.int64)), pa.array(n_runs.astype(np.int64)), pa.array(longest)]
        yield pa.RecordBatch.from_arrays(columns, names)


def later_copies(keyed: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """``kn, kd, kt, cut, n_cut, n_runs, longest_run`` of documents with later copies.

    ``cut`` is a flag for each line up to the last one to delete.
    """
    placed, docs = place_lines(as_table(line_rows(keyed, text_col)))
    copies = longest_copies(suffix_ranks(placed))
    rows = placed.select("doc", "pos", "stretch", "words").join(copies, "pos", "left")
    line = F.struct(
        (F.col("pos") - F.col("doc")).alias("no"), "stretch", "words",
        F.coalesce("lines", F.lit(0).cast("long")).alias("lines"),
    )
    whole = rows.groupBy("doc").agg(F.array_sort(F.collect_list(line)).alias("found"), F.max("lines").alias("most"))
    schema = "doc long, cut array<boolean>, n_cut long, n_runs long, longest_run long"
    cuts = whole.where("most > 0").drop("most").mapInArrow(lambda batches: _cuts(batches, min_words), schema)
    return cuts.join(docs, "doc").drop("doc")


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of line runs deleted from the text.

    The columns of ``docs`` stay (``text`` is what is left of it) and
    ``n_lines, n_removed, n_runs, longest_run`` are added; columns of these
    names are replaced. Lines end at ``\\n`` and are compared as they are; those
    without a word are never copies and end a run. A run goes if it occurs as a
    whole at an earlier place, can't be made longer at either end as a copy, and
    has ``min_words`` words or more; ``n_runs`` counts those, which may overlap,
    and ``n_removed`` their lines. ``longest_run`` is the length of the longest
    run with an earlier copy, of however many words, 0 if none.

    Copies are judged on the input, by order of document and line. Within a
    document the first copy stays as well; a copy may overlap the earlier one.
    Rows that repeat an id and a text are one document and get the same
    result. Documents are ordered by id, null ids last, then by a hash of the
    text. A null text stays null and has 0 lines; an empty text is one line. An
    empty table gives no rows.
    """
    extra = ["n_lines", "n_removed", "n_runs", "longest_run"]
    own = [c for c in docs.columns if c not in (*extra, "cut", "n_cut")]
    hidden = docs.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(own)])
    names = {c: f"x{i}" for i, c in enumerate(own)}
    keyed = _keyed(hidden, names[id_col], names[text_col])
    cuts = later_copies(keyed, names[text_col], min_words)
    before = F.col(names[text_col])
    lines = F.split(before, "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("cut", i), F.lit(False))), "\n")
    text = F.when(F.coalesce(F.col("n_cut"), F.lit(0)) > 0, left).otherwise(before)
    kept = [(text if c == text_col else F.col(names[c])).alias(c) for c in own]
    n_lines = F.when(before.isNull(), 0).otherwise(F.size(lines)).cast("long")
    counts = [F.coalesce(c, F.lit(0)).cast("long") for c in ("n_cut", "n_runs", "longest_run")]
    added = [c.alias(n) for c, n in zip([n_lines, *counts], extra, strict=True)]
    return keyed.join(cuts, KEY, "left").select(*kept, *added)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", kept.alias("kept_sha256"))


#: Compares windows of every length.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
),
r AS (SELECT line, row_number() OVER () AS id FROM l WHERE words > 0 GROUP BY line HAVING count(*) > 1),
act AS (SELECT doc_id, i, id, words, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM l JOIN r USING (line)),
s AS (SELECT doc_id, stretch, min(i) AS i0, list(id ORDER BY i) AS ids FROM act GROUP BY doc_id, stretch),
n AS (SELECT *, unnest(range(1, len(ids) + 1)) AS n FROM s),
w AS (SELECT doc_id, i0 + k - 1 AS i, n, ids[k : k + n - 1] AS win FROM (SELECT *, unnest(range(1, len(ids) - n + 2)) AS k FROM n)),
f AS (SELECT doc_id, i, n, first_value((doc_id, i)) OVER (PARTITION BY win ORDER BY doc_id, i) AS fst FROM w),
m AS (SELECT doc_id, i, max(n) AS n FROM f WHERE (doc_id, i) <> fst GROUP BY doc_id, i),
b AS (
  SELECT m.doc_id, m.i, m.n FROM m
  LEFT JOIN m AS p ON p.doc_id = m.doc_id AND p.i = m.i - 1
  WHERE p.n IS NULL OR p.n - 1 < m.n
),
ok AS (
  SELECT b.doc_id, b.i, b.n FROM b JOIN l ON l.doc_id = b.doc_id AND l.i BETWEEN b.i AND b.i + b.n - 1
  GROUP BY b.doc_id, b.i, b.n HAVING sum(words) >= 5
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM ok),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_runs FROM ok GROUP BY doc_id),
x AS (SELECT doc_id, max(n) AS longest FROM m GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest, 0)::BIGINT AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
