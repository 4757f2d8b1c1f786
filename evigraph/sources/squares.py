"""A small Python data source with several partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Squares(DataSourceReader):
    def __init__(self, count: int):
        self.count = count

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(range(a, min(a + 32, self.count))) for a in range(0, self.count, 32)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int]]:
        for n in partition.value:
            yield n, n * n


class SquareSource(DataSource):
    """``n, square`` for n below the option ``count``."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Squares(int(self.options.get("count", "0")))
