"""spark.read.format("sheet") over workbooks: one partition a file, rows as they are read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workbooks import CELLS, read_bytes, record


class Files(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        for row in read_bytes(data, partition.value):
            yield record(partition.value, row)


class SheetSource(DataSource):
    """Local or mounted files (option path, commas between several); read_cells reads any store that Spark does."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema):
        import glob

        found = [p for pattern in self.options["path"].split(",") for p in sorted(glob.glob(pattern.removeprefix("file://")))]
        return Files(found)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
