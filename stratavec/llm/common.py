"""What the operators of this subpackage share: tables in the shared folder, columns of any name, components."""

from __future__ import annotations

import contextlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components, forest
from ..sources.scratch import drop, keep, new_path, shared_folder

__all__ = ["bounded", "byte_texts", "components", "drop", "forest", "keep", "new_path", "parts_for", "settle", "shared_folder", "with_fields", "wrapped"]


#: Bytes of one Arrow batch handed to a Python worker at most. One longer row still makes a batch of its own.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, its session's Arrow batches bounded in bytes: texts are long, and a batch is in memory several times. A
    caller's own lower bound stays. The frame runs when the caller likes, so the setting has to stay too."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgt".find(unit or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def with_fields(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    """The frame's schema and further fields (name, type), whatever the names are."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in more]])


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """All of a row's columns in one struct _row, and the named columns beside it, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def byte_texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def settle() -> None:
    """A task's last call: give memory that its large arrays leave with the allocators back to the system, as the worker
    lives on beside the next tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library isn't glibc
        ctypes.CDLL(None).malloc_trim(0)


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))
