"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Categories that the
targets don't name share the target of ``*``, so the targets bound the number of
cells, and the table of cells is a small aggregate however large the corpus.
Fitting rakes the cells' token weights to one marginal after the other; after
each step a weight is held to what the cell can supply. A document's probability
is its cell's weight times the token budget over the cell's tokens, and it is
sampled if a uniform number from a hash of its id is below that.

Everything is one DataFrame plan: the cells are gathered into one row, fitted by
higher-order functions, and broadcast back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, documents

#: Production targets: shares of tokens by category; ``*`` is any other.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.22, "src1": 0.08, "src2": 0.08, "*": 0.62},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14},
    "topic": {"prose": 0.9, "table": 0.04, "symbols": 0.02, "contact": 0.04},
}
#: Most cells that targets may span: they are fitted in one row and broadcast.
MOST_CELLS = 10_000
#: Sampled tokens as a share of all, and raking steps for each marginal.
BUDGET, ROUNDS = 0.5, 20

#: What a text holds that puts it in a topic; the first wins.
TOPICS = [("table", " | "), ("symbols", "%%%"), ("contact", "@")]


def topic_of(text: Column) -> Column:
    """A coarse topic by layout; ``prose`` if nothing else fits."""
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def category(column: Column, targets: dict[str, float]) -> Column:
    """The target that a value counts for; null counts for ``*``."""
    return F.when(column.isin([k for k in targets if k != "*"]), column).otherwise(F.lit("*"))


def uniform(ident: Column) -> Column:
    """A number in [0, 1) from the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def fit_cells(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float, rounds: int) -> DataFrame:
    """``c0, c1, c2, tokens`` with the fitted share and probability of each cell.

    Targets are scaled to the categories that have tokens; a category without
    a target gets none. If no category of a marginal has one, that marginal is
    left as it is.
    """
    names = list(targets)
    quoted = lambda k: "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
    maps = ", ".join("map(" + ", ".join(f"{quoted(k)}, {float(v)!r}D" for k, v in targets[n].items()) + ")" for n in names)
    key = f"element_at({{}}.k, (i % {len(names)}) + 1)"
    cell = "named_struct('k', c.k, 'tokens', c.tokens, 'cap', c.cap, 't', c.t, 'w', {w})"
    total = "aggregate(cells, 0D, (s, c) -> s + c.tokens)"
    of = [f"coalesce(element_at(element_at(array({maps}), {i + 1}), c.k[{i}]), 0D)" for i in range(len(names))]
    scale = [f"aggregate(array_distinct(transform(cells, c -> named_struct('n', c.k[{i}], 'v', {of[i]}))), 0D, (s, d) -> s + d.v)" for i in range(len(names))]
    share = ", ".join(f"coalesce(try_divide({of[i]}, scale[{i}]), -1D)" for i in range(len(names)))
    wanted = f"element_at(c.t, (i % {len(names)}) + 1)"
    held = f"aggregate(filter(acc, d -> {key.format('d')} = {key.format('c')}), 0D, (s, d) -> s + d.w)"
    step = f"transform(acc, c -> {cell.format(w=f'if({wanted} < 0, c.w, least(c.cap, coalesce(c.w * try_divide({wanted}, {held}), 0D)))')})"
    return (
        cells.agg(F.array_sort(F.collect_list(F.struct(F.array("c0", "c1", "c2").alias("k"), F.col("tokens").cast("double").alias("tokens")))).alias("cells"))
        .where("size(cells) > 0")
        .selectExpr("cells", f"{total} AS total", f"array({', '.join(scale)}) AS scale")
        .selectExpr(f"transform(cells, c -> named_struct('k', c.k, 'tokens', c.tokens, 'cap', c.tokens / ({budget!r}D * total), 't', array({share}), 'w', c.tokens / total)) AS cells")
        .selectExpr(f"explode(aggregate(sequence(0, {rounds * len(names) - 1}), cells, (acc, i) -> {step})) AS c")
        .selectExpr("c.k[0] AS c0", "c.k[1] AS c1", "c.k[2] AS c2", "c.w AS share", "c.w / c.cap AS probability")
    )


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Each document's cell, probability and whether it is sampled.

    Returns the columns in ``keep`` (the id by default) and ``mix_source,
    mix_lang, mix_topic, n_tokens, probability, sampled``. ``budget`` is the
    share of all tokens to sample. Where a cell can't supply its weight, its
    probability is 1 and the other cells make up for it as far as they can.

    Targets of more than ``MOST_CELLS`` cells raise ``ValueError``, which bounds
    what is broadcast. ``residuals`` tells which targets aren't met.

    Tokens are words between ASCII white space. Documents of 0 tokens (null and
    empty texts) weigh nothing: those of a cell with tokens get its
    probability, those of a cell without any are always sampled. Null sources
    and languages count for ``*``. Rows that repeat an id share its fate. An
    empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    names = ["source", "lang", "topic"]
    if math.prod(len(targets[n].keys() | {"*"}) for n in names) > MOST_CELLS:
        raise ValueError(f"the targets span more than {MOST_CELLS} cells")
    values = [F.col(source_col), F.col(lang_col), topic_of(F.col(text_col)) if topic is None else topic]
    cells = {f"c{i}": category(v, targets[n]) for i, (n, v) in enumerate(zip(names, values, strict=True))}
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [id_col] if keep is None else keep
    used = docs.select(*[F.col(c).alias(f"k_{c}") for c in kept], F.col(id_col).alias("id"), *[v.alias(k) for k, v in cells.items()], tokens.alias("n_tokens"))
    counts = used.select("c0", "c1", "c2", "n_tokens").groupBy("c0", "c1", "c2").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    fitted = fit_cells(counts, {n: targets[n] for n in names}, budget, rounds)
    p = F.round(F.coalesce(F.col("probability"), F.lit(1.0)), 9)
    return used.join(F.broadcast(fitted), ["c0", "c1", "c2"], "left").select(
        *[F.col(f"k_{c}").alias(c) for c in kept], F.col("c0").alias("mix_source"), F.col("c1").alias("mix_lang"), F.col("c2").alias("mix_topic"), "n_tokens", p.alias("probability"), (uniform(F.col("id")) < p).alias("sampled")
    )


def residuals(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """How far each marginal is from its target: ``marginal, category, target,
    share, residual, supply``.

    ``mixed`` comes from ``mix``. ``share`` is the category's part of the
    expected tokens, ``supply`` its tokens over what the target asks of the
    expected total: below 1, the target can't be met at this budget whatever the
    other categories do. A row for each category with a target or documents.
    """
    targets = TARGETS if targets is None else targets
    names = ["source", "lang", "topic"]
    weight = (F.col("probability") * F.col("n_tokens")).alias("w")
    cells = mixed.groupBy(*[F.col(f"mix_{n}").alias(n) for n in names]).agg(F.sum(weight).alias("w"), F.sum("n_tokens").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("marginal"), F.col(n).alias("category")) for n in names])).alias("x")
    held = cells.select(each, "w", "n").groupBy("x.marginal", "x.category").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    total = held.groupBy("marginal").agg(F.sum("w").alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("marginal"), F.lit(c).alias("category"), F.lit(float(v)).alias("target")) for n in names for c, v in targets[n].items()]))
    wanted = mixed.sparkSession.range(1).select(asked.alias("x")).select("x.*")
    out = held.join(total, "marginal").join(wanted, ["marginal", "category"], "full").join(total.withColumnRenamed("total", "all"), "marginal", "left")
    target, share = F.coalesce("target", F.lit(0.0)), F.coalesce(F.try_divide("w", "total"), F.lit(0.0))
    supply = F.try_divide(F.coalesce(F.col("n").cast("double"), F.lit(0.0)), target * F.col("all"))
    return out.select("marginal", "category", target.alias("target"), share.alias("share"), (share - target).alias("residual"), supply.alias("supply"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def _sql() -> str:
    """The same as SQL, the raking unrolled."""

    def cat(col: str, name: str) -> str:
        return f"CASE WHEN {col} IN ({', '.join(repr(k) for k in TARGETS[name] if k != '*')}) THEN {col} ELSE '*' END"

    def target(col: str, name: str) -> str:
        return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in TARGETS[name].items()) + " ELSE 0 END"

    topic = "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in TOPICS) + " ELSE 'prose' END"
    parts = [
        f"d AS (SELECT doc_id, {cat('source', 'source')} AS c0, {cat('lang', 'lang')} AS c1, {cat(f'({topic})', 'topic')} AS c2, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)",
        "c AS (SELECT c0, c1, c2, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    names = ["source", "lang", "topic"]
    for i, n in enumerate(names):
        parts.append(f"t{i} AS (SELECT v AS c{i}, {target('v', n)} / (SELECT sum({target('v', n)}) FROM (SELECT DISTINCT c{i} AS v FROM c)) AS t{i} FROM (SELECT DISTINCT c{i} AS v FROM c))")
    parts.append(f"w0 AS MATERIALIZED (SELECT c.*, t0, t1, t2, tokens / ({BUDGET!r} * sum(tokens) OVER ()) AS cap, tokens / sum(tokens) OVER () AS w FROM c JOIN t0 USING (c0) JOIN t1 USING (c1) JOIN t2 USING (c2))")
    for step in range(ROUNDS * 3):
        i = step % 3
        parts.append(f"w{step + 1} AS MATERIALIZED (SELECT * REPLACE (least(cap, coalesce(w * (t{i} / nullif(sum(w) OVER (PARTITION BY c{i}), 0)), 0)) AS w) FROM w{step})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, c0 AS mix_source, c1 AS mix_lang, c2 AS mix_topic, n_tokens, p AS probability,
  ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE < p AS sampled
FROM (SELECT d.*, round(coalesce(w / cap, 1), 9) AS p FROM d LEFT JOIN w{ROUNDS * 3} USING (c0, c1, c2))"""


OP2_SQL = _sql()
