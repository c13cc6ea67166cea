"""What the text operators share: word splitting, stored intermediate tables, table access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package, stored

__all__ = ["arrow_schema", "discard", "key_id", "map_batches", "map_rows", "shared_folder", "slices", "stored", "table", "word_list"]

#: Rows turned into Python objects at a time, so that a batch of long texts stays small.
SLICE_ROWS = 256

#: Lower-cases A-Z and blanks every ASCII byte that is neither a letter nor a digit; bytes of other letters stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_list(data: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased (A-Z) UTF-8 text."""
    return data.translate(WORD_TABLE).split() if data else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of shared_folder whose rows have been read for the last time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def key_id(column: str = "doc_id"):
    """doc_id for equi-joins: a null id takes the smallest long, which no table uses."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string with the simple types that the operators return."""
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.strip().split() for part in ddl.split(","))])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, with this package on the workers' path."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """Runs ``make()`` once per task; the function it returns takes a slice's columns as lists and yields output rows."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch):
                rows = list(each(*(c.to_pylist() for c in part.columns)))
                columns = list(zip(*rows)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(df, run, ddl)
