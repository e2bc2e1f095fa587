"""Words as the operators see them: maximal runs without ASCII white space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regular expression of one separator.
SPACE = "[\\x20\\x09-\\x0D]"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(c: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, where it would otherwise be inlined into a lambda."""
    return F.transform(F.array(value), body)[0]


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def in_fold(c: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == fold, F.lit(False))


def crc_fold(doc_id: int | None, parts: int) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def least_hashes(df: DataFrame, limit: int, h: str = "h", n: int | None = None) -> DataFrame:
    """The limit rows with the least hashes of a seeded hash column, of n rows (counted here if not given).

    Of many rows, about twice the limit are drawn by a bound of the hash (spread over
    all longs) first, so that the tasks hand on few rows altogether, however many tasks there are.
    """
    n = df.count() if n is None else n
    if n > 4 * limit:
        df = df.where(F.col(h) < int(2**64 * 2 * limit / n) - 2**63)
    return df.orderBy(h).limit(limit)


def hash_bound(df: DataFrame, limit: int, h: str = "h", n: int | None = None) -> int:
    """The hash of the last of least_hashes: rows up to it are found again by a filter, and never move."""
    return least_hashes(df.select(h), limit, h, n).agg(F.max(h)).first()[0] or 0


def in_parts(batch: pa.RecordBatch, place: int = 1, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with about size bytes in the text column at place (one row at least),
    so that a task holds little beside the batch itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end
