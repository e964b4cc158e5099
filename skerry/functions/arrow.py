"""Python inside tasks, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_lists(df: DataFrame, f: Callable[[Iterator[list[list]]], Iterable[list[tuple]]], ddl: str) -> DataFrame:
    """``f`` gets an iterator over batches, each the columns of ``df`` as lists, and yields lists
    of output rows in the order of ``ddl``.  Nothing is held beyond a batch unless ``f`` holds it."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in f([c.to_pylist() for c in b.columns] for b in batches):
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)
