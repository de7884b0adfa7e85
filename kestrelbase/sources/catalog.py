"""A registry of collections, series, buckets and queues over tables or files, with backup and restore."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kestrelbase.operators.timeseries import TimeQuery
from kestrelbase.plans.query import Query

KINDS = ("collection", "series", "bucket", "queue")
FORMATS = ("parquet", "json", "csv", "orc", "text", "binaryFile")


@dataclass
class Catalog:
    """Names of each kind and the lazy DataFrames behind them."""

    spark: SparkSession
    objects: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def register(self, kind: str, name: str, df: DataFrame) -> DataFrame:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        self.objects[kind, name] = df
        if kind == "collection":
            df.createOrReplaceTempView(name)
        return df

    def open(self, kind: str, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
        """Register files of any format Spark reads."""
        if fmt not in FORMATS:
            raise ValueError(f"unknown format: {fmt}")
        return self.register(kind, name, self.spark.read.format(fmt).options(**options).load(path))

    def get(self, kind: str, name: str) -> DataFrame:
        if (kind, name) not in self.objects:
            raise KeyError(f"no {kind} named {name}")
        return self.objects[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.objects if k == kind)

    def query(self, name: str) -> Query:
        return Query(self.get("collection", name), name)

    def series(self, name: str) -> TimeQuery:
        return TimeQuery(self.get("series", name))

    def backup(self, path: str) -> None:
        """Write every object under ``path``."""
        for (kind, name), df in self.objects.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")

    def restore(self, path: str, objects: list[tuple[str, str]]) -> None:
        for kind, name in objects:
            self.open(kind, name, f"{path}/{kind}/{name}")
