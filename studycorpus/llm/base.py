"""Helpers that several operators share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from studycorpus.plans.scale import checkpointed, components, shared_folder, shuffle_width

__all__ = ["checkpointed", "shared_folder", "shuffle_width", "text_of", "components", "crc32_mod4", "slices", "portions", "free_names"]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column of the caller has, in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of them is small as well."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: at most ``rows`` rows, and about ``most`` bytes of a text
    or binary column unless a single value is larger."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column % batch.num_columns)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


def crc32_mod4(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4
