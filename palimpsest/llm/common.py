"""Helpers that the operators share: reading, shared-folder tables, and Arrow maps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import discard, release, stored

__all__ = ["discard", "map_texts", "release", "split_batch", "stored", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add under these names (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes]], Sequence]], added: str, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Adds columns computed from whole texts in Python, a row for each row.

    make() runs once a task and returns a function from a list of UTF-8 texts (null: empty) to a list of columns in the order of `added`, a DDL schema.
    keep names the columns that stay (all by default); clashing ones give way to the added ones.
    """
    schema = T.StructType.fromDDL(added)
    base = without(df if keep is None else df.select(*dict.fromkeys(keep)), schema.fieldNames())
    sent = df.select(*base.columns, F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("__text"))
    out = T.StructType([*base.schema.fields, *schema.fields])
    wanted = to_arrow_schema(out)
    types = [wanted.field(i).type for i in range(len(base.columns), len(wanted))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for part in split_batch(b):
                cols = work(part.column(part.num_columns - 1).to_pylist())
                new = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(cols, types)]
                kept = [c.cast(wanted.field(i).type) if c.type != wanted.field(i).type else c for i, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=wanted.names)

    return sent.mapInArrow(run, out)


def split_batch(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes, so that long texts do not pile up in Python."""
    rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
