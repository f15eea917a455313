"""Sources that users write: one class with a fetch, read in parallel through Spark's data source interface."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "source string, page int, payload string, complete boolean, cursor string"


class Connector:
    """A kind of source.  type names it; delta tells whether a cursor gives changes only."""

    type, delta = "", False

    def configs(self, options: dict[str, str]) -> list[dict]:
        """One dict for each source to read, with its name under "source" and, after an earlier read, its "cursor"."""
        return json.loads(options["sources"])

    def fetch(self, config: dict, cursor: str | None) -> Iterator[tuple[str, str | None]]:
        """(payload, cursor after it) of each page, one at a time; runs in a task, and again if the task is lost."""
        raise NotImplementedError


@dataclass
class _One(InputPartition):
    config: dict


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, options: dict[str, str]):
        self.connector, self.options = connector, options

    def partitions(self) -> list[_One]:
        return [_One(c) for c in self.connector.configs(self.options)]

    def read(self, partition: _One) -> Iterator[tuple]:
        cursor = partition.config.get("cursor")
        complete = not (self.connector.delta and cursor)
        for n, (payload, after) in enumerate(self.connector.fetch(partition.config, cursor)):
            yield partition.config["source"], n, payload, complete, after


def register(spark: SparkSession, kind: type[Connector]) -> None:
    """Makes spark.read.format(kind.type) give rows of PAGES, a task for each source, to be parsed by the functions of `api`."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind.type

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind(), dict(self.options))

    spark.dataSource.register(Source)
