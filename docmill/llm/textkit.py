"""Byte-level text machinery shared by the operators: Arrow plumbing, words, polynomial hashes.

Everything works on slices of bounded size, so memory follows the slice and the largest single
text, never the table.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.readers import table as table

#: Bytes of text that one numpy pass works on; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 20
#: Odd multiplier of the prefix hashes (wrap-around arithmetic modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one process is given a temporary one and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="docmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts at the default of 10,000 rows take tens of MB on both sides of a worker; a smaller setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved_by_key(df: DataFrame) -> DataFrame:
    """A checkpoint that remembers how its rows are partitioned, so that later joins on that key do not move them.

    Adaptive execution hides the partitioning of a checkpoint, so it is off while this one is written.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return saved(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def released(spark: SparkSession) -> None:
    """Collects the driver's garbage: shuffle files that a checkpoint has made unreachable go, and the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def give_back() -> None:
    """Returns what the allocators of this process hold free to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which the worker gives free memory back: it outlives the task, and stays beside the heap of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    text_col: str | None = None,
) -> DataFrame:
    """Narrow, shuffle-free map: `make()` runs once a task and returns batch -> new columns.

    An input column with the name of a new one is replaced by it; all others pass through. With
    `text_col`, batches are cut so that they hold about 8 MB of that column at most.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in fields]
    base = df.drop(*[c for c in df.columns if c in names])
    schema = T.StructType([*base.schema.fields, *fields])
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for batch in cut(whole, text_col):
                new = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [new[n] for n in names], names=[*kept, *names])

    return base.mapInArrow(lean(run), schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name` with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows or more (but for the last) out of batches sorted by `keys`; rows of a key stay together."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            whole = pa.Table.from_batches(held)
            last = np.ones(count, bool)
            for k in keys:
                values = whole[k].to_numpy()
                last &= values == values[-1]
            cut = int(np.argmax(last))
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            count -= cut
    if count:
        yield pa.Table.from_batches(held)


def cut(batch: pa.RecordBatch, text_col: str | None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    if text_col is None or batch.num_rows == 0:
        yield batch
        return
    _, offs = flat(batch.column(text_col))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (or one row)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, _U64), np.full(size, self.inverse, _U64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            self.up, self.down, self.n = up, down, size
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_MIXED_BYTES = mix(np.arange(1, 257, dtype=_U64) * _U64(0xA24BAED4963EE407))


def prefix_sums(data: np.ndarray, powers: Powers = _POWERS, values: np.ndarray = _MIXED_BYTES) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(byte) * BASE**position over [i, j)."""
    up, _ = powers.upto(max(len(data), 1))
    out = np.zeros(len(data) + 1, _U64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """Position-independent hash of [start, end), mixed with the length."""
    _, down = powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U64) * _U64(0x8CB92BA72F3D8DD7))


def word_table() -> np.ndarray:
    """Byte -> its A-Z-lower-cased byte if it belongs to a word (0-9, a-z, 0x80 and above), else 0."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    keep = np.zeros(256, bool)
    keep[ord("0") : ord("9") + 1] = keep[ord("A") : ord("Z") + 1] = keep[ord("a") : ord("z") + 1] = True
    keep[0x80:] = True
    out[~keep] = 0
    return out


WORDS = word_table()


def blank_table() -> np.ndarray:
    """Byte -> itself unless it is a space or one of 0x09-0x0D (then 0)."""
    out = np.arange(256, dtype=np.uint8)
    out[[0x20, 9, 10, 11, 12, 13, 0]] = 0
    return out


@dataclass
class Words:
    hash: np.ndarray  # uint64 of each word's (lower-cased) bytes
    start: np.ndarray  # byte positions in the slice
    end: np.ndarray
    off: np.ndarray  # words of row i: off[i]:off[i + 1]
    low: np.ndarray  # the slice's bytes, 0 where no word is


def spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of non-zero bytes; runs never cross rows."""
    n = len(low)
    inside = low != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offs: np.ndarray, lut: np.ndarray = WORDS) -> Words:
    low = lut[data]
    start, end = spans(low, offs)
    out = np.empty(len(start), _U64)
    i = 0
    while i < len(start):  # by blocks of words: hashing memory stays bounded in long rows
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        a, b = start[i], end[j - 1]
        out[i:j] = range_hash(prefix_sums(low[a:b]), start[i:j] - a, end[i:j] - a)
        i = j
    return Words(out, start, end, np.searchsorted(start, offs), low)


def word_slices(column: pa.Array, lut: np.ndarray = WORDS, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(row from, row to, bytes, offsets, words) by slices of bounded size."""
    data, offs = flat(column)
    for i, j in slices(offs, most):
        own = offs[i : j + 1] - offs[i]
        part = data[offs[i] : offs[j]]
        yield i, j, part, own, words(part, own, lut)


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)
