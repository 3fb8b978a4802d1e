"""Python over Arrow batches in which integers stay integers and untouched columns stay as they are.

On the usual way to pandas one null turns a column of integers into doubles, which hold 53 bits: ids that are hashes
would change, and different ids become equal.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch as a data frame; integers beside nulls are Python's integers and None."""
    return pd.DataFrame({name: column.to_pandas(integer_object_nulls=True) for name, column in zip(batch.schema.names, batch.columns)})


def text_of(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def record(schema: pa.Schema, columns) -> pa.RecordBatch:
    """A batch of columns by name: arrays of numpy, pandas or Arrow, or lists."""
    arrays = [columns[f.name] for f in schema]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type, from_pandas=True) for f, x in zip(schema, arrays)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def map_frames(rows: DataFrame, run, ddl: str) -> DataFrame:
    """run, from data frames to data frames (or dicts of columns), over the partitions of rows."""
    schema = arrow_schema(ddl)

    def go(batches):
        for pdf in run(frame(b) for b in batches if b.num_rows):
            yield record(schema, pdf)
    return rows.mapInArrow(go, ddl)
