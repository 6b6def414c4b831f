"""Row-wise extractors run over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


#: Bytes of an Arrow batch on its way to a worker, and rows and bytes of one on its way back; a larger row is a batch of its own.
IN_BYTES, OUT_ROWS, OUT_BYTES = 16 << 20, 1024, 8 << 20


def importable(spark) -> None:
    """Lets Python workers import this package where it isn't installed, and bounds the session's batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(IN_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def flat_mapped(df: DataFrame, schema: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows_of(*values of a row) gives the rows that replace it; results leave in batches that are bounded by rows and bytes."""
    importable(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def run(batches):
        out = to_arrow_schema(kind)
        held: list[tuple] = []
        size = 0

        def batch():
            columns = list(zip(*held, strict=True)) if held else [()] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for part in batches:
            for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for row in rows_of(*values):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                    if len(held) >= OUT_ROWS or size >= OUT_BYTES:
                        yield batch()
                        held.clear()
                        size = 0
        if held:
            yield batch()

    return df.mapInArrow(run, kind)
