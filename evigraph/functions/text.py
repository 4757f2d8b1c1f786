"""Text expressions and small text plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evigraph.operators.bounds import broadcast_if_small

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, white space is folded."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.regexp_replace(plain, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def chunk(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``doc_id, chunk_no, chunk``: windows of ``size`` characters."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int") - 1
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.substring(F.col("text"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_no, sentence`` split after a full stop or a line end."""
    parts = F.filter(F.split("text", r"(?:\. |\n)"), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("n", "sentence")).select("doc_id", F.col("n").cast("long").alias("sentence_no"), "sentence")


def ngrams(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, ngram`` of words, repeats included."""
    words = tokens(F.col("text"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return docs.select("doc_id", words.alias("w")).where(F.size("w") >= n).select("doc_id", F.explode(grams).alias("ngram"))


#: Passages of up to so many bytes together are sent to every executor.
MOST_PASSAGE_BYTES = 4 << 20


def locate_spans(docs: DataFrame, passages: DataFrame, most_bytes: int = MOST_PASSAGE_BYTES) -> DataFrame:
    """Where each passage occurs first in each document: ``item_id, doc_id, offset``.

    Passages of up to ``most_bytes`` together are searched for at once by an
    automaton, in one pass over the texts and without a shuffle. More of them
    are joined by keys. Null texts hold and are nothing; an empty passage is at
    offset 1 of every text.
    """
    used = passages.select("item_id", "text").where(F.col("text").isNotNull())
    size = used.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    return _scan_spans(docs, used) if size <= most_bytes else _join_spans(docs, used)


def _scan_spans(docs: DataFrame, passages: DataFrame) -> DataFrame:
    items: dict[str, list] = {}
    for row in passages.collect():  # bounded by locate_spans
        items.setdefault(row["text"], []).append(row["item_id"])
    everywhere, words = items.pop("", []), list(items.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text, ids in words:
            machine.add_word(text, (len(text), ids))
        machine.make_automaton()
        for batch in batches:
            found = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                first = dict.fromkeys(everywhere, 1)
                for end, (size, ids) in machine.iter(text) if words else ():
                    for i in ids:
                        first.setdefault(i, end - size + 2)
                found += [(i, doc, at) for i, at in first.items()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (item_type, batch["doc_id"].type, pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "offset"])

    kinds = {"item_id": passages.schema["item_id"].dataType, "doc_id": docs.schema["doc_id"].dataType}
    item_type = to_arrow_type(kinds["item_id"])
    schema = ", ".join(f"{n} {k.simpleString()}" for n, k in kinds.items()) + ", offset long"
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)


def _join_spans(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The second to fifth word of a passage stand whole in any document that holds
    it, so passages of six words or more are joined by those and then checked in
    full. Shorter ones are searched for in every document; they are broadcast
    if they are few.
    """
    split = lambda c: F.split(F.translate(c, "\n\t\r", "   "), " ")
    marked = passages.select("item_id", F.col("text").alias("passage"), split(F.col("text")).alias("w"))
    offset = F.expr("locate(passage, text)").cast("long").alias("offset")
    long_ones = marked.where(F.size("w") >= 6).select("item_id", "passage", F.array_join(F.slice("w", 2, 4), " ").alias("key"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    worded = docs.select("doc_id", split(F.col("text")).alias("w")).where(F.size("w") >= 4)
    keys = worded.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    near = keys.join(broadcast_if_small(long_ones), "key").select("item_id", "doc_id", "passage").distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", offset)
    short = marked.where(F.size("w") < 6).select("item_id", "passage")
    scanned = docs.select("doc_id", "text").join(broadcast_if_small(short), F.expr("contains(text, passage)")).select("item_id", "doc_id", offset)
    return found.unionByName(scanned).where("offset > 0")
