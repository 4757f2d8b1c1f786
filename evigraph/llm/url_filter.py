"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix with a verdict. The keys of a URL that a rule
could match are few: for each label count and path length that occur in the
rule list, the host's last labels joined with the path's first characters. The
complete key universe is the set of those keys over the whole corpus.

For each verdict a cascade is built over that universe. Level 1 encodes the
listed keys; level 2 encodes the universe's keys that level 1 takes for listed
although they aren't; level 3 encodes the listed keys that level 2 takes for
unlisted, and so on until no key of the universe is judged wrongly. Level 1 is
sized so that about as many keys pass it wrongly as are listed, later levels
err for half of the keys, so all levels together take a few bytes for each
listed key, however large the corpus is. Applied to a key of the universe the
answer is exact, and it takes a few hashes and no join. The salt of a level is
hashed before the key, so keys that collide in one level don't in the next; what
is judged wrongly after ``MOST_LEVELS`` levels all the same is listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed

#: Levels of a cascade at most, and keys that may be left then. Every level
#: halves the keys judged wrongly, so none are left of any corpus there is.
MOST_LEVELS, MOST_LEFT = 64, 1000
#: Rules that are broadcast at most, and bytes of one filter.
MOST_BROADCAST, MOST_BYTES = 100_000, 256 << 20
#: Bits in a byte of a filter: such bytes are ASCII characters.
BYTE = 7

#: Fixed values: (host, path prefix, verdict) of the production rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` holds ``bits`` bits, probed ``hashes`` times."""

    words: bytes
    bits: int
    hashes: int
    salt: int


@dataclass(frozen=True)
class Cascade:
    """The levels, and the keys that they judge wrongly."""

    levels: tuple[Level, ...] = ()
    left: tuple[str, ...] = ()


def _probes(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Bit positions of a key (double hashing)."""
    first = F.pmod(F.xxhash64(F.lit(2 * salt), key), F.lit(bits).cast("long"))
    step = F.pmod(F.xxhash64(F.lit(2 * salt + 1), key), F.lit(bits).cast("long"))
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def bloom_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the ``key`` column. Only its words reach the driver."""
    hashes = max(1, round(math.log2(1 / rate)))
    size = max(8, math.ceil(count * hashes / math.log(2) / BYTE))
    if size > MOST_BYTES:
        raise ValueError(f"a filter of {size} bytes is too large for a plan")
    bits = size * BYTE
    at = keys.select(F.explode(F.array(*_probes(F.col("key"), bits, hashes, salt))).alias("bit"))
    one = F.expr(f"shiftleft(1, cast(bit % {BYTE} as int))")
    words = at.groupBy(F.expr(f"bit div {BYTE}").alias("word")).agg(F.bit_or(one).alias("bits"))
    full = bytearray(size)
    for row in words.toLocalIterator():  # as many as the filter has bytes, at most
        full[row["word"]] = row["bits"]
    return Level(bytes(full), bits, hashes, salt)


def passes(level: Level, key: Column) -> Column:
    words = F.lit(bytearray(level.words))
    tests = []
    for p in _probes(key, level.bits, level.hashes, level.salt):
        at = F.floor(p / BYTE).cast("int")
        word = F.ascii(F.substring(words, at + 1, F.lit(1)).cast("string"))
        mask = F.call_function("shiftleft", F.lit(1), (p % BYTE).cast("int"))
        tests.append(word.bitwiseAND(mask) != 0)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = MOST_LEVELS) -> Cascade:
    """Levels that tell the ``key`` rows of ``listed`` from the rest of ``universe``.

    ``listed`` should be part of ``universe``; keys outside it are not looked
    up. An empty ``listed`` gives no level, and every key is then unlisted.
    """
    count = listed.count()
    if not count:
        return Cascade()
    size = max(universe.count(), count)
    right, wrong = listed, universe.join(listed, "key", "left_anti")
    rate = min(0.5, max(count * math.sqrt(0.5) / size, 2.0**-40))
    levels: list[Level] = []
    while count and len(levels) < most_levels:
        levels.append(bloom_level(right, count, rate, len(levels)))
        errors = wrong.where(passes(levels[-1], F.col("key")))
        right, wrong, rate = checkpointed(errors), right, 0.5
        count = right.count()
    left = tuple(r["key"] for r in right.orderBy("key").limit(MOST_LEFT + 1).collect()) if count else ()
    if len(left) > MOST_LEFT:
        raise ValueError(f"more than {MOST_LEFT} keys are left after {len(levels)} levels")
    return Cascade(tuple(levels), left)


def is_listed(cascade: Cascade, key: Column) -> Column:
    """Exact membership of a key of the universe."""
    levels = cascade.levels
    out = F.lit(len(levels) % 2 == 1)
    if cascade.left:
        out = F.when(key.isin(list(cascade.left)), F.lit(len(levels) % 2 == 0)).otherwise(out)
    for number in range(len(levels) - 1, -1, -1):
        out = F.when(~passes(levels[number], key), F.lit(number % 2 == 1)).otherwise(out)
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the URL is null or has no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """All keys by which one of the rules could match."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -c), F.substring(path, 1, n))) for c in labels for n in lengths]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def fitting_rules(keys: Column, cascade: Cascade, verdict: str) -> Column:
    """The listed ones of a URL's keys, with their length and verdict."""
    fits = F.filter(keys, lambda key: is_listed(cascade, key))
    return F.transform(fits, lambda key: F.struct(F.length(key).alias("n"), key.alias("rule"), F.lit(verdict).alias("verdict")))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest rule wins. Where none fits, the rule is null and the
    verdict is ``default``: the key is in no cascade, so it is unlisted.

    A null URL, one without ``://`` and an empty one have an empty host and an
    empty path and fit no rule. Repeated rows are judged one by one, an empty
    table gives no rows, a null id is kept, and other columns are ignored.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    judged = judged.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    spark = pages.sparkSession
    universe = checkpointed(judged.select(F.explode("keys").alias("key")).distinct())
    picked = []
    for verdict in ("allow", "block"):
        keys = sorted({h + p for h, p, v in rules if v == verdict})
        table = spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))
        listed = universe.join(F.broadcast(table) if len(keys) <= MOST_BROADCAST else table, "key", "left_semi")
        cascade = build_cascade(checkpointed(listed), universe)
        picked.append(fitting_rules(F.col("keys"), cascade, verdict))
    best = F.array_max(F.concat(*picked))
    return judged.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM u
"""
