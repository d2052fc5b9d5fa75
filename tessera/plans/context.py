"""The context: a session, its settings, and everything that makes streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators import stateful
from tessera.plans.stream import Dataset, OrderedStream, Stream
from tessera.sources import custom, files, rest

#: Engine settings and the Spark settings that they stand for.
SETTINGS = {
    "optimize_joins": "spark.sql.cbo.joinReorder.enabled",
    "broadcast_threshold": "spark.sql.autoBroadcastJoinThreshold",
    "batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "partition_bytes": "spark.sql.files.maxPartitionBytes",
    "shuffle_partitions": "spark.sql.shuffle.partitions",
}


class Context:
    def __init__(self, spark: SparkSession | None = None, **settings):
        self.spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
        for k, v in settings.items():
            self.set_config(k, v)

    def set_config(self, key: str, value) -> None:
        self.spark.conf.set(SETTINGS.get(key, key), str(value).lower() if isinstance(value, bool) else str(value))

    def get_config(self, key: str) -> str:
        return self.spark.conf.get(SETTINGS.get(key, key))

    # Files

    def read_csv(self, table_location: str, schema: Sequence[str] | str | T.StructType | None = None, has_header: bool = False, sep: str = ",") -> Stream:
        """A CSV file, folder or `folder/*`; names from a list or the header.  With DDL or a StructType the file is read once."""
        return Stream(files.csv(self.spark, table_location, schema, has_header, sep))

    def read_parquet(self, table_location: str) -> Stream:
        return Stream(files.parquet(self.spark, table_location))

    def read_sorted_csv(self, table_location: str, sorted_by: str, schema=None, has_header: bool = False, sep: str = ",") -> OrderedStream:
        return self.read_csv(table_location, schema, has_header, sep).ordered(sorted_by)

    def read_sorted_parquet(self, table_location: str, sorted_by: str, schema=None) -> OrderedStream:
        return self.read_parquet(table_location).ordered(sorted_by)

    def read_json(self, table_location: str, schema: str | T.StructType | None = None) -> Stream:
        """JSON lines."""
        return Stream(files.json(self.spark, table_location, schema))

    def read_text(self, table_location: str, column: str = "text") -> Stream:
        """A row a line."""
        return Stream(self.spark.read.text(files.folder(table_location)).toDF(column))

    def read_files(self, table_location: str) -> Stream:
        """Whole files: filename, object."""
        return Stream(files.blobs(self.spark, table_location))

    def read_lance(self, table_location: str, vec_column: str) -> Stream:
        """A vector dataset; other than Lance it may be Parquet with an array column."""
        return Stream(files.vectors(self.spark, table_location, vec_column))

    def read_iceberg(self, table: str, snapshot: int | None = None) -> Stream:
        return Stream(files.iceberg(self.spark, table, snapshot))

    def read_delta(self, table_location: str, version: int | None = None) -> Stream:
        return Stream(files.delta(self.spark, table_location, version))

    # Services and memory

    def read_rest_get(self, url: str, data: Sequence[str], schema: Sequence[str], headers: Mapping[str, str] | None = None, batch_size: int = 10_000, **options) -> Stream:
        """GET url + entry for each entry of data; a row a JSON object.

        Requests are tried `tries` times (3).  One that fails for good is an error; with on_error="skip" it gives no row, with "report"
        a row of nulls and the reason in a column `error`.
        """
        return Stream(rest.get(self.spark, url, data, schema, headers or {}, batch_size, **options))

    def read_rest_post(self, url: str, data: Sequence, schema: Sequence[str], headers: Mapping[str, str] | None = None, batch_size: int = 10_000, **options) -> Stream:
        """POST each entry of data as JSON; the rows of each answer's `result`.  Options and failures as for GET."""
        return Stream(rest.post(self.spark, url, data, schema, headers or {}, batch_size, **options))

    def read_custom(self, reader, schema: str | T.StructType, channels: int = 8) -> Stream:
        """A reader with get_own_state(channels) and execute(channel, state), as a Spark data source."""
        return Stream(custom.read(self.spark, reader, schema, channels))

    def read_dataset(self, dataset: Dataset) -> Stream:
        return Stream(dataset.df)

    def read_ray_dataset(self, dataset) -> Stream:
        """A Ray dataset, through its Arrow blocks; needs ray."""
        import ray

        return self.from_arrow(pa.concat_tables(ray.get(dataset.to_arrow_refs())))

    def from_arrow(self, table: pa.Table) -> Stream:
        return Stream(self.spark.createDataFrame(table))

    def from_pandas(self, frame) -> Stream:
        return Stream(self.spark.createDataFrame(frame))

    def from_polars(self, frame) -> Stream:
        return self.from_arrow(frame.to_arrow())

    def from_spark(self, df: DataFrame) -> Stream:
        return Stream(df)

    # Plans

    def sql(self, text: str, **streams: Stream) -> Stream:
        """SQL over streams by name ({name} in the text) and the session's tables."""
        return Stream(self.spark.sql(text, **{k: v.df for k, v in streams.items()}))

    def mingle(self, sources: Sequence[Stream], operator, new_schema, required_cols: Sequence[Sequence[str]]) -> Stream:
        return Stream(stateful.mingle([s.df for s in sources], operator, new_schema, required_cols))
