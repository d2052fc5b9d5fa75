"""User-defined readers as Spark data sources."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.stateful import tables


class _Share(InputPartition):
    def __init__(self, channel: int, state):
        self.channel, self.state = channel, state


class _Reader(DataSourceReader):
    def __init__(self, reader, channels: int, names: list[str]):
        self.reader, self.channels, self.names = reader, channels, names

    def partitions(self):
        return [_Share(channel, state) for channel, states in sorted(self.reader.get_own_state(self.channels).items()) for state in states]

    def read(self, partition):
        for table in tables(self.reader.execute(partition.channel, partition.state)):
            yield from table.select(self.names).to_batches()


class CustomSource(DataSource):
    """Format "tessera_custom"; the reader travels pickled in an option."""

    @classmethod
    def name(cls) -> str:
        return "tessera_custom"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(pickle.loads(bytes.fromhex(self.options["reader"])), int(self.options["channels"]), schema.names)


def read(spark: SparkSession, reader, schema: str | T.StructType, channels: int) -> DataFrame:
    """reader.get_own_state(channels) gives {channel: [state, ...]}, reader.execute(channel, state) Arrow or pandas data."""
    spark.dataSource.register(CustomSource)
    return spark.read.format("tessera_custom").schema(schema).option("reader", cloudpickle.dumps(reader).hex()).option("channels", channels).load()
