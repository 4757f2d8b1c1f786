"""Probabilistic record linkage.

Records that share a blocking key are compared field by field, each comparison
giving a level: 0 for different, higher for more alike, -1 where a side is null.
How often each level occurs among matches and among others is estimated by
expectation-maximisation over the counts of the patterns of levels, without
labels; there are few patterns, whatever the records. A pair's weight is the sum
of its levels' log ratios and of the prior's. Pairs of enough weight are links,
and linked records are an entity, which is marked where two of its records were
compared and speak against each other.

Equal records are folded into one before they are compared, so many copies make
no pairs. Blocks are joined by key, a large one in tiles, and a pair is made in the
first block that its records share; so pairs are streamed, to be counted and then
to be weighed, and are neither shuffled nor stored. Their number still grows with
the square of a block, which ``most`` may limit: a larger block then raises.

So a pair must be cheap. Tiles are runs of a block's records by id, so none meets
another twice; edit distances are only taken, up to their limit, where the counts
of characters allow it; and a pair's weight is looked up by its pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.bounds import dealt as spread
from evigraph.operators.graph import components
from evigraph.sources.shared import as_table

#: For each field the conditions of its levels, the most alike first; ``l`` and ``r`` are the records.
Comparisons = dict[str, list[str]]

ROUNDS = 20
#: Where the estimate starts: the share of matches, and how often the best level
#: is met by matches and by others.
START = (0.1, 0.9, 0.1)
#: Made-up pairs of each level and class, so no rate is zero.
PSEUDO = 0.5
#: Records of a tile of a block, and pairs that a task should compare.
TILE = 512
TASK_PAIRS = 10_000_000
MOST_TASKS = 4096
#: Records by key that a task places in their blocks.
BLOCK_ROWS = 100_000
#: Patterns of levels, seen or not, up to which weights are a table.
MOST_PATTERNS = 4096
_DISTANCE = re.compile(r"\blevenshtein\(\s*l\.(\w+)\s*,\s*r\.(\w+)\s*\)\s*<=\s*(\d+)", re.IGNORECASE)


def sieves(text: str) -> dict[str, Column]:
    """Bits of a column that an edit of its text changes few of. ``once``: how often the
    characters of each of 16 classes occur, up to four times, a bit for each time; an edit
    changes two at most. ``even``, ``odd``: which neighbours occur, by their hash; four at most."""
    value, bits = F.col(text).cast("string"), []
    for i in range(16):
        of_class = "".join(chr(c) for c in range(33, 127) if c % 16 == i)
        times = F.least(F.length(value) - F.length(F.translate(value, of_class, "")), F.lit(4))
        bits.append(F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), times) - 1, 4 * i))
    grams = F.transform(F.sequence(F.lit(0), F.length(value)), lambda i: F.pmod(F.hash(F.substring(value, i, F.lit(2))), F.lit(128)))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 1))
    half = lambda odd: F.aggregate(F.filter(grams, lambda h: h % 2 == odd), F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h)))
    return {f"once_{text}": reduce(Column.bitwiseOR, bits), f"even_{text}": half(0), f"odd_{text}": half(1)}


def _sieved(condition: str) -> str:
    """``condition``, its edit distances taken up to their limit and behind the sieves."""
    few = r"bit_count(l.once_\1 ^ r.once_\2) <= 2 * \3 AND bit_count(l.even_\1 ^ r.even_\2) + bit_count(l.odd_\1 ^ r.odd_\2) <= 4 * \3"
    return _DISTANCE.sub(rf"({few} AND levenshtein(l.\1, r.\2, \3) >= 0)", condition)


def _level(field: str, conditions: list[str]) -> Column:
    out = F.when(F.expr(f"l.{field} IS NULL OR r.{field} IS NULL"), -1)
    for i, condition in enumerate(conditions):
        out = out.when(F.expr(_sieved(condition)), len(conditions) - i)
    return out.otherwise(0)


def _tiles(records: DataFrame, fields: Comparisons, blocks: list[str], most: int | None = None, within: str | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame, Column]:
    """The records as ``l`` and as ``r``, copied to the tiles that they meet, and which of them are a pair."""
    keys = [f"block_{i}" for i in range(len(blocks))]
    named = records.select("*", *[F.expr(b).cast("string").alias(k) for k, b in zip(keys, blocks, strict=True)])
    sieved = {x for conditions in fields.values() for c in conditions for *both, _ in _DISTANCE.findall(c) for x in both}
    named = named.select("*", *[c.alias(k) for x in sorted(sieved) for k, c in sieves(x).items()])
    part = F.lit("") if within is None else F.col(within).cast("string")
    keyed = named.select("*", part.alias("block_part"), F.posexplode(F.array(*keys)).alias("block_no", "block_key"))
    keyed = keyed.where("block_key IS NOT NULL AND block_part IS NOT NULL AND rec_id IS NOT NULL")
    by = ["block_part", "block_no", "block_key"]
    keyed = spread(keyed, records.count() * len(keys), *by, each=BLOCK_ROWS)
    placed = keyed.withColumn("place", F.dense_rank().over(Window.partitionBy(*by).orderBy("rec_id")))
    placed = placed.withColumn("tiles", F.ceil(F.max("place").over(Window.partitionBy(*by)) / tile).cast("int"))
    dealt = as_table(placed.withColumn("tile", F.floor((F.col("place") - 1) / tile).cast("int")))
    sizes = dealt.groupBy(*by).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.max("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("pairs")).first()
    if most is not None and (whole["n"] or 0) > most:
        raise ValueError(f"a block has {whole['n']} records; finer keys are needed")
    tasks = int(min(max((whole["pairs"] or 0) / 2 / TASK_PAIRS, dealt.sparkSession.sparkContext.defaultParallelism), MOST_TASKS))
    cell = [*by, "i", "j"]
    left = dealt.select("*", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j")).repartition(tasks, *cell)
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j")).repartition(tasks, *cell)
    together = [f"l.{c} = r.{c}" for c in cell] + ["l.place < r.place"]
    first = [f"NOT coalesce(l.block_no > {i} AND l.{k} = r.{k}, false)" for i, k in enumerate(keys[:-1])]
    return left.alias("l"), right.alias("r"), F.expr(" AND ".join(together + first))


def _pairs(tiles: tuple[DataFrame, DataFrame, Column], fields: Comparisons, *also: str, keep: Callable[[list[Column]], Column] | None = None) -> DataFrame:
    """The pairs of which ``keep`` is true, given their levels; asked last, as the levels cost most."""
    left, right, meet = tiles
    levels = [_level(f, c) for f, c in fields.items()]
    both = left.join(right, meet & keep(levels) if keep else meet)
    return both.select(F.col("l.rec_id").alias("a"), F.col("r.rec_id").alias("b"), *[F.col(f"l.{x}").alias(x) for x in also], *[x.alias(f"g_{f}") for f, x in zip(fields, levels, strict=True)])


def candidate_pairs(records: DataFrame, fields: Comparisons, blocks: list[str], most: int | None = None, within: str | None = None, tile: int = TILE) -> DataFrame:
    """``a, b, g_<field>...``: records that share a block's key, ``a < b``, each pair once.

    ``blocks`` are SQL expressions over a record; a null key blocks nothing. With
    ``within`` both must agree in that column, which is then returned too. Pairs
    are made anew each time they are read; only the records are stored.
    """
    return _pairs(_tiles(records, fields, blocks, most, within, tile), fields, *[within] * (within is not None))


def estimate(levels: np.ndarray, counts: np.ndarray, sizes: list[int], rounds: int = ROUNDS) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """The share of matches and, for each field, the rates of its levels among
    matches and among others, after ``rounds`` rounds. Null levels say nothing."""
    prior, best_m, best_u = START
    m = [np.r_[np.full(n, (1 - best_m) / n), best_m] for n in sizes]
    u = [np.r_[np.full(n, (1 - best_u) / n), best_u] for n in sizes]
    for _ in range(rounds):
        yes, no = np.full(len(counts), prior), np.full(len(counts), 1 - prior)
        for f in range(len(sizes)):
            known = levels[:, f] >= 0
            yes[known] *= m[f][levels[known, f]]
            no[known] *= u[f][levels[known, f]]
        match = counts * yes / (yes + no)
        prior = float(match.sum() / max(counts.sum(), 1))
        for f, n in enumerate(sizes):
            known = levels[:, f] >= 0
            for rates, share in ((m, match), (u, counts - match)):
                got = np.bincount(levels[known, f], share[known], n + 1) + PSEUDO
                rates[f] = got / got.sum()
        prior = min(max(prior, 1e-9), 1 - 1e-9)
    return prior, m, u


def weight(pairs: DataFrame, fields: Comparisons, rounds: int = ROUNDS) -> Callable[[list[Column]], Column]:
    """log2 of the odds that a pair of such levels is one, rounded to six places, as estimated from ``pairs``."""
    names, sizes = [f"g_{f}" for f in fields], [len(c) for c in fields.values()]
    patterns = pairs.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # a row for each pattern
    levels = np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(-1, len(names))
    prior, m, u = estimate(levels, np.array([r["n"] for r in patterns], np.float64), sizes, rounds)
    totals = [float(np.log2(prior / (1 - prior)))]
    ratios = [[0.0, *map(float, np.log2(m[f] / u[f]))] for f in range(len(names))]
    doubles = lambda xs: F.expr(f"array({', '.join(f'{x!r}D' for x in xs)})")
    if np.prod([len(r) for r in ratios], dtype=float) > MOST_PATTERNS:
        return lambda levels: F.round(reduce(lambda t, x: t + F.get(doubles(x[0]), x[1] + 1), zip(ratios, levels, strict=True), F.lit(totals[0])), 6)
    for ratio in ratios:
        totals = [t + x for t in totals for x in ratio]
    rounded = [float(Decimal(repr(t)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0 for t in totals]
    place = lambda levels: reduce(lambda at, x: at * len(x[0]) + x[1] + 1, zip(ratios, levels, strict=True), F.lit(0))
    return lambda levels: F.coalesce(F.get(doubles(rounded), place(levels)), F.lit(0.0))  # is never null, so no filter makes the levels again to ask


def weighted(pairs: DataFrame, fields: Comparisons, rounds: int = ROUNDS) -> DataFrame:
    """``pairs`` with ``weight``."""
    return pairs.withColumn("weight", weight(pairs, fields, rounds)([F.col(f"g_{f}") for f in fields]))


def _linked(records: DataFrame, links: DataFrame) -> DataFrame:
    """``rec_id, entity`` by links ``a, b``."""
    links = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return as_table(components(records.select(F.col("rec_id").alias("node_id")), links).toDF("rec_id", "entity"))


def _marked(found: DataFrame, odd: DataFrame) -> DataFrame:
    odd = odd.select("entity", F.lit(True).alias("conflict")).distinct()
    return found.join(odd, "entity", "left").select("rec_id", "entity", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def entities(records: DataFrame, pairs: DataFrame, least: float = 0.0, against: float = -10.0) -> DataFrame:
    """``rec_id, entity, conflict``: the smallest record that each is linked with,
    by links of a weight above ``least``, and whether two of the entity's
    records were compared with a weight below ``against``."""
    found = _linked(records, pairs.where(F.col("weight") > least))
    of = lambda side: found.select(F.col("rec_id").alias(side), F.col("entity").alias(f"entity_{side}"))
    odd = pairs.where(F.col("weight") < against).join(of("a"), "a").join(of("b"), "b").where("entity_a = entity_b")
    return _marked(found, odd.select(F.col("entity_a").alias("entity")))


def link_records(records: DataFrame, fields: Comparisons, blocks: list[str], least: float = 0.0, against: float = -10.0, most: int | None = None) -> DataFrame:
    """``rec_id, entity, conflict`` of all records (rec_id and the fields), as ``entities``.

    Records that agree in all columns but the id are one for the comparisons, and
    are one entity. Records without a block's key, or with nulls, stay; null ids
    are left out. Of the pairs only links are stored; what speaks against an
    entity is looked for among the pairs within entities.
    """
    own = [c for c in records.columns if c != "rec_id"]
    used = records.where("rec_id IS NOT NULL")
    folded = as_table(used.groupBy(*own).agg(F.min("rec_id").alias("first")).withColumnRenamed("first", "rec_id"))
    tiles = _tiles(folded, fields, blocks, most)
    odds = weight(_pairs(tiles, fields), fields)
    links = as_table(_pairs(tiles, fields, keep=lambda levels: odds(levels) > least).select("a", "b"))
    found = _linked(folded, links)
    several = found.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    inside = _tiles(folded.join(found.join(several, "entity"), "rec_id"), fields, blocks, within="entity")
    marked = _marked(found, _pairs(inside, fields, "entity", keep=lambda levels: odds(levels) < against))
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in own])
    each = used.alias("l").join(folded.alias("r"), same).select(F.col("l.rec_id").alias("rec_id"), F.col("r.rec_id").alias("first"))
    return each.join(marked.withColumnRenamed("rec_id", "first"), "first").select("rec_id", "entity", "conflict")
