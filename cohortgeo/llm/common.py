"""What the text operators share: batch limits, text buffers, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes that one Arrow batch of texts may hold; memory of a Python worker follows from them.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Make the Arrow batches of this session small enough for whole, long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a Spark type's name."""
    return to_arrow_type(T._parse_datatype_string(kind))


def map_batches(df: DataFrame, columns: list[str], added: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """`columns` of df as they are, and what `work` makes of each batch, as columns of the DDL schema `added`."""
    bounded_batches(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    new = T._parse_datatype_string(added)
    if clash := set(columns) & set(new.names):
        raise ValueError(f"columns {sorted(clash)} are made here and can't be kept as well")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = work(batch)
            made = [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=False) for x in (got[n] for n in new.names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *new.names])
            del batch, made
        pa.default_memory_pool().release_unused()  # the worker lives on, beside an executor that wants the memory

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))
