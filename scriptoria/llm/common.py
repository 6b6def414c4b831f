"""What the training-data operators share: tables, scratch space in the shared folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch, and bytes of text worked on at once; they only bound memory.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 512, 8 << 20, 1 << 20
#: Rows for one file of a stored table whose number of rows is known; there are at least as many files as cores.
FILE_ROWS = 500_000


def prepare(spark: SparkSession) -> None:
    """Makes the package importable by Python workers and bounds Arrow batches, in rows and in bytes, for this session."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; where it is unset (local runs, tests) an own folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='scriptoria-')}")
    return root


_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: cuts lineage and survives lost executors.

    rows: no more rows than that, if known; then tasks and files follow it, so that a loop's small tables aren't hundreds
    of files. (On a local file system without Hadoop's native library each file also costs several processes.)"""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that this process has stored, once all results that read them are written; how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def arrow_map(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict] | None]) -> DataFrame:
    """mapInArrow over slices of at most SLICE_BYTES of strings (or one row). work takes a slice and gives a dict of columns."""
    from pyspark.sql.types import _parse_datatype_string

    prepare(df.sparkSession)
    kind = _parse_datatype_string(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        for batch in batches:
            for part in slices(batch):
                got = work(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([as_arrow(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            sizes += np.diff(offsets_of(col))
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto


def offsets_of(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32) if len(col) and col.buffers()[1] else np.zeros(col.offset + len(col) + 1, np.int64)
    return raw[col.offset : col.offset + len(col) + 1].astype(np.int64)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other, and len+1 offsets into them; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    off = offsets_of(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def longs(col: pa.Array) -> pa.Array:
    return col.cast(pa.int64())
