"""What the corpus operators share: table access, written intermediate tables, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, forget, new_path, shared_dir, written

__all__ = ["discard", "forget", "new_path", "shared_dir", "written"]

#: The word of every contract, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Records of an Arrow batch: texts may be long, and a worker holds a batch and what it makes of it.
BATCH = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Caps the session's Arrow batches at BATCH records, so that workers hold little text at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, BATCH)


def release() -> None:
    """Gives a worker's freed memory back: it stays alive for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until no column of df is called so."""
    there, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        there.add(n.lower())
        out.append(n)
    return out


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def held_out(doc_id: str, mod: int) -> Column:
    """True where the fold is 2; a null id is never held out."""
    return F.coalesce(fold(doc_id, mod) == 2, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    """ASCII lower case, split at the six ASCII blanks; bytes.split() knows exactly those."""
    return text.lower().split() if text else []


def byte_values(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def spans(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs, with the total at the end."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
