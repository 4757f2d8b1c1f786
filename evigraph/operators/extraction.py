"""Entities, events, relations and times from text by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own kinds and the patterns that find them.
ENTITY_RULES = {
    "email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}",
    "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "card": r"[0-9]{16}",
    "licence": r"(?:MIT|Apache|BSD|GPL) License",
    "key": r"(?:token|secret) = \"[0-9a-f]+\"",
}
#: Kinds that name a person or an account; a licence names no one and links nothing.
NAMING = ("email", "phone", "card", "key")


def extract(chunks: DataFrame, rules: dict[str, str], text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id, kind, value`` for every match of every rule."""
    rows = [F.transform(F.regexp_extract_all(F.col(text), F.lit(rule), 0), _tag(kind)) for kind, rule in rules.items()]
    return chunks.select(ident, F.explode(F.concat(*rows)).alias("x")).select(ident, "x.kind", "x.value")


def _tag(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def extract_entities(chunks: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    return extract(chunks, ENTITY_RULES, text, ident)


#: Our own eight event types and the wording that tells them.
EVENT_RULES = {
    "click": r"clicked", "view": r"viewed", "purchase": r"purchased", "signup": r"signed up", "error": r"hit an error",
    "refund": r"was refunded", "login": r"logged in", "share": r"shared",
}
#: Our own nine relations: what two kinds of entity in one line have to do with each other.
RELATION_RULES = {
    ("card", "email"): "card_of_address", ("card", "key"): "card_beside_key", ("card", "licence"): "card_under_licence",
    ("card", "phone"): "card_of_caller", ("email", "key"): "key_of_address", ("email", "licence"): "address_under_licence",
    ("email", "phone"): "reachable_at", ("key", "licence"): "key_under_licence", ("licence", "phone"): "caller_under_licence",
}
#: Our own three kinds of time and their patterns.
TIME_RULES = {
    "instant": r"[0-9]{4}-[0-9]{2}-[0-9]{2} at [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "day": r"on [0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "week": r"in the week of [0-9]{4}-[0-9]{2}-[0-9]{2}",
}
_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"


def extract_times(texts: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id, kind, day, clock`` for every time that a text names; ``clock`` is
    null but for instants. A day that no calendar has is null."""
    found = extract(texts, TIME_RULES, text, ident)
    clock = F.nullif(F.regexp_extract("value", r"([0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit(""))
    return found.select(ident, "kind", F.try_to_date(F.regexp_extract("value", _DAY, 1), "yyyy-MM-dd").alias("day"), clock.alias("clock"))


def extract_events(texts: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id, event_type, actor``: each event that a text tells, ``user N`` before
    its wording being the actor."""
    rules = {kind: rf"user [0-9]+ {wording}" for kind, wording in EVENT_RULES.items()}
    found = extract(texts, rules, text, ident)
    return found.select(ident, F.col("kind").alias("event_type"), F.regexp_extract("value", r"user ([0-9]+)", 1).cast("long").alias("actor"))


def extract_relations(texts: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``doc_id, relation, a, b``: entities of two kinds in one line, distinct.

    Kinds are paired in order of name; pairs without a rule are no relation.
    """
    lines = texts.select(ident, F.explode(F.split(text, "\n")).alias("line"))
    each = [F.transform(F.array_distinct(F.regexp_extract_all("line", F.lit(rule), 0)), _tag(kind)) for kind, rule in ENTITY_RULES.items()]
    found = lines.withColumn("found", F.concat(*each)).where(F.size("found") > 1)
    names = F.create_map(*[F.lit(x) for (a, b), name in RELATION_RULES.items() for x in (f"{a} {b}", name)])
    both = found.select(ident, F.explode("found").alias("x"), "found").select(ident, "x", F.explode("found").alias("y"))
    named = both.where(F.col("x.kind") < F.col("y.kind")).withColumn("relation", names[F.concat_ws(" ", "x.kind", "y.kind")])
    return named.where("relation IS NOT NULL").select(ident, "relation", F.col("x.value").alias("a"), F.col("y.value").alias("b")).distinct()


def normalised(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^0-9A-Za-z@.]", ""))


def document_entities(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, entity``, distinct, of the kinds that name someone."""
    found = extract_entities(docs).where(F.col("kind").isin(*NAMING))
    return found.select("doc_id", "kind", normalised(F.col("value")).alias("entity")).distinct()


def link_entities(entities: DataFrame) -> DataFrame:
    """One entity for each kind and normalised value, with its mentions."""
    return entities.groupBy("kind", normalised(F.col("value")).alias("entity")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))
