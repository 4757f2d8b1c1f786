"""Documents over HTTP as a Python data source, and their stand-in from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evigraph.sources.pdf import pdf_text


def _get(url: str, timeout: float) -> tuple[int | None, str | None, str | None]:
    """Status, text and error of a page. One that fails has an error."""
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace"), None
    except Exception as e:
        return None, None, str(e)


class _Fetch(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value, *_get(partition.value, self.timeout))


class WebSource(DataSource):
    """``spark.read.format("web").option("urls", "a b")``: a row for each URL."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Fetch(self.options.get("urls", "").split(), float(self.options.get("timeout", "10")))


def fetch(spark: SparkSession, urls: list[str], timeout: float = 10) -> DataFrame:
    spark.dataSource.register(WebSource)
    return spark.read.format("web").option("urls", " ".join(urls)).option("timeout", str(timeout)).load()


def fetch_rows(pages: DataFrame, url: str = "url", timeout: float = 10) -> DataFrame:
    """``pages`` with ``status, html, error`` of each URL, fetched where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, None, None) if u is None else _get(u, timeout) for u in batch[url].to_pylist()]
            columns = list(zip(*got, strict=True)) or [(), (), ()]
            added = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "status", "html", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, status int, html string, error string")


def parse_files(spark: SparkSession, path: str, to_text=pdf_text, pattern: str = "*.pdf") -> DataFrame:
    """Binary files to text by ``to_text(bytes) -> str``, by default that of PDF pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    @F.pandas_udf("string")
    def parsed(contents):
        return contents.map(to_text)

    return files.select("path", "length", parsed("content").alias("text"))
