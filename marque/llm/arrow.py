"""Small Arrow helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marque.llm import hashing

#: Rows and text bytes handled at once by a Python worker; bounds its memory for any partition.
SLICE_ROWS = 512
SLICE_BYTES = 1_000_000


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and what the allocators keep would add up."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory released at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def slices(batch: pa.RecordBatch, sizes: Iterable[int | None] | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most SLICE_ROWS rows and about so many bytes (a longer row is alone)."""
    if sizes is None:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)
        return
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and (total + n > most or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, by: int | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over small slices. by: the column whose byte lengths bound a slice; done: called as a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            sizes = None if by is None else pc.binary_length(batch.column(by)).to_pylist()
            for part in slices(batch, sizes):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
        if done is not None:
            done()

    return df.mapInArrow(tidy(run), schema)
