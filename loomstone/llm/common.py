"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, under fixed names; a null text is empty. Columns whose names clash go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of text in one slice, so that a worker's arrays keep their size however long the texts are (one text at least).
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``most_bytes`` bytes of strings and binaries."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and (i - at >= rows or total + size > most_bytes):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(at)


class Known(dict):
    """What was made of keys, bounded, in two generations: what was not asked for during a generation goes. Long keys are not kept."""

    def __init__(self, make: Callable, most: int, longest: int = 100) -> None:
        super().__init__()
        self.make, self.half, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_RESIDENT: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, such as a vocabulary with its caches: one object for each worker, made anew
    when another one was in use meanwhile."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def let_go(key: object) -> None:
    """Frees what a task of another operator left in this worker: workers are used again, and its caches would lie beside the new task's."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]], schema: str, rows: int = 1024, keeps: object = None) -> DataFrame:
    """mapInArrow in slices of bounded size. ``make`` runs once in each task and returns the function of a slice; ``keeps`` is the key
    of the resident object that it takes, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        fn = make()
        for batch in batches:
            for part in slices(batch, rows):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()
