"""An example of a source through the Python data source interface."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, rows: int) -> None:
        self.rows = rows

    def partitions(self):
        step = max(1, self.rows // 4)
        return [InputPartition((a, min(a + step, self.rows))) for a in range(0, self.rows, step)]

    def read(self, partition):
        a, b = partition.value
        for i in range(a, b):
            yield (i, f"row {i}")


class NumberedLines(DataSource):
    """Rows (id, text) with as many lines as the option ``rows`` says."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "id long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("rows", "10")))
