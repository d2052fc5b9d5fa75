"""REST services, fetched by the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: What becomes of an entry whose request failed for good: an error, no row, or a row with the reason in a column `error`.
ON_ERROR = ("raise", "skip", "report")


def _fetch(request: urllib.request.Request, timeout: float, tries: int):
    """The decoded answer; network errors and those of the server are tried again, after longer and longer pauses."""
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429 or not left:
                raise
        except OSError:
            if not left:
                raise
        time.sleep(0.2 * 2 ** (tries - 1 - left))


def _rows(spark: SparkSession, entries: Sequence[str], schema: str | Sequence[str] | T.StructType, batch_size: int, ask: Callable[[str], list[dict]], on_error: str) -> DataFrame:
    """A table of ask(entry)'s objects; absent keys are null.  Columns given by name alone are strings (JSON text if nested)."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {', '.join(ON_ERROR)}")
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema) if isinstance(schema, str) else T.StructType([T.StructField(n, T.StringType()) for n in schema])
    names = kind.names
    strings = {f.name for f in kind if isinstance(f.dataType, T.StringType)}
    if on_error == "report":
        kind = T.StructType([*kind.fields, T.StructField("error", T.StringType())])
    parts = max(1, -(-len(entries) // batch_size), min(len(entries), spark.sparkContext.defaultParallelism))
    given = spark.createDataFrame([(e,) for e in entries], "entry string").repartition(parts)

    def text(name: str, value):
        return value if value is None or name not in strings or isinstance(value, str) else json.dumps(value)

    def answered(entry: str) -> list[dict]:
        try:
            return [{n: text(n, o.get(n)) for n in names} for o in ask(entry)]
        except (OSError, ValueError) as error:
            if on_error == "raise":
                raise RuntimeError(f"no answer for {entry!r}: {error}") from error
            return [{"error": f"{entry}: {error}"}] if on_error == "report" else []

    shape = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            rows = [r for e in batch.column(0).to_pylist() for r in answered(e)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return given.mapInArrow(run, kind)


def get(spark: SparkSession, url: str, data: Sequence[str], schema, headers: Mapping[str, str], batch_size: int, timeout: float = 30, on_error: str = "raise", tries: int = 3) -> DataFrame:
    head = dict(headers)

    def ask(entry: str) -> list[dict]:
        got = _fetch(urllib.request.Request(url + entry, headers=head), timeout, tries)
        if not isinstance(got, dict):
            raise ValueError("the answer is not an object")
        return [got]

    return _rows(spark, [str(d) for d in data], schema, batch_size, ask, on_error)


def post(spark: SparkSession, url: str, data: Sequence, schema, headers: Mapping[str, str], batch_size: int, timeout: float = 30, on_error: str = "raise", tries: int = 3) -> DataFrame:
    head = {"Content-Type": "application/json"} | dict(headers)

    def ask(entry: str) -> list[dict]:
        got = _fetch(urllib.request.Request(url, data=entry.encode(), headers=head, method="POST"), timeout, tries)
        if not isinstance(got, dict) or "result" not in got:
            raise ValueError("the answer has no result")
        found = got["result"]
        return [o for o in found if isinstance(o, dict)] if isinstance(found, list) else [found] if isinstance(found, dict) else []

    return _rows(spark, [json.dumps(d) for d in data], schema, batch_size, ask, on_error)
