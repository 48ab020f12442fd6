"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of every benchmark item (an item with fewer
words is one window). The alphabet of the search is the word: a block is two words (one for
one-word windows), the SHIFT table is a hashed array that says how far the window may jump given
the block at its end, blocks with shift 0 select a bucket of patterns by the suffix hash, a prefix
hash thins the bucket, and the words' bytes are compared directly.

A table's rows are cut into runs of words that overlap by one window, and the cursors of all runs
of a slice advance together, so long texts cost no more than many short ones. The scan is a narrow
map: no shuffle, and rows pass through in place. The benchmark reaches the tasks in blocks of
`block_bytes` of text at most; more than one block means one pass over the documents a block, with
the hits so far carried along, so the whole benchmark may be of any size.

Edge cases: null or wordless texts have no words and no hits; wordless items have no window and
never occur; repeated rows are judged alike; rows of the benchmark with a null item id are left out,
their text is not searched; an empty benchmark hits nothing; input columns named like the result columns are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Words, append_columns, mix, saved, word_slices

_U64 = np.uint64
RUN_WORDS = 512
SHIFT_BITS = 18


def blocks_of(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` words that ends at each position."""
    last = hashes[at]
    return mix(last if size == 1 else hashes[at - 1] * _U64(0x9DDFEA08EB382D69) + last)


@dataclass
class Patterns:
    """Windows of one length: shift table, suffix buckets, prefix hashes, bytes and owners."""

    length: int
    block: int
    shift: np.ndarray
    bucket_keys: np.ndarray
    bucket_from: np.ndarray
    bucket_to: np.ndarray
    prefix: np.ndarray
    text: list[bytes]
    owners: list[np.ndarray]


def windows_of(column: pa.Array, window: int) -> dict[int, dict[bytes, tuple[np.ndarray, set[int]]]]:
    """Window length -> words' bytes -> (word hashes, item numbers)."""
    out: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = defaultdict(dict)
    for i, j, _, _, w in word_slices(column):
        raw = w.low.tobytes()
        for row in range(j - i):
            a, b = int(w.off[row]), int(w.off[row + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                key = b" ".join(raw[x:y] for x, y in zip(w.start[s : s + n].tolist(), w.end[s : s + n].tolist(), strict=True))
                out[n].setdefault(key, (w.hash[s : s + n], set()))[1].add(i + row)
    return out


def compile_patterns(length: int, found: dict[bytes, tuple[np.ndarray, set[int]]]) -> Patterns:
    text = list(found)
    hashes = np.stack([found[t][0] for t in text])
    block = min(2, length)
    shift = np.full(1 << SHIFT_BITS, length - block + 1, np.int32)
    for end in range(block - 1, length):
        slot = blocks_of(hashes.ravel(), np.arange(len(text)) * length + end, block) >> _U64(64 - SHIFT_BITS)
        np.minimum.at(shift, slot, length - 1 - end)
    suffix = blocks_of(hashes.ravel(), np.arange(len(text)) * length + length - 1, block)
    order = np.argsort(suffix, kind="stable")
    keys, first, count = np.unique(suffix[order], return_index=True, return_counts=True)
    prefix = mix(hashes[:, 0] * _U64(3) + hashes[:, length // 2])
    return Patterns(length, block, shift, keys, first, first + count, prefix[order], [text[k] for k in order], [np.array(sorted(found[text[k]][1])) for k in order])


def search(w: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every occurrence in the slice; windows stay within a row."""
    m = p.length
    rows = np.flatnonzero(np.diff(w.off) >= m)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs: starts of windows [s, t) of each row, cut every RUN_WORDS
    a, b = w.off[rows], w.off[rows + 1] - m + 1
    pieces = -(-(b - a) // RUN_WORDS)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(a, pieces) + k * RUN_WORDS
    stop = np.minimum(at + RUN_WORDS, np.repeat(b, pieces)) + m - 1
    at = at + m - 1  # cursors stand on the last word of the window
    ends = []
    while len(at):
        jump = p.shift[blocks_of(w.hash, at, p.block) >> _U64(64 - SHIFT_BITS)]
        ends.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    end = np.concatenate(ends)
    suffix = blocks_of(w.hash, end, p.block)
    slot = np.searchsorted(p.bucket_keys, suffix)
    slot[slot == len(p.bucket_keys)] = 0
    hit = p.bucket_keys[slot] == suffix
    end, slot = end[hit], slot[hit]
    n = p.bucket_to[slot] - p.bucket_from[slot]
    which = np.repeat(p.bucket_from[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(end, n) - m + 1
    same = p.prefix[which] == mix(w.hash[start] * _U64(3) + w.hash[start + m // 2])
    start, which = start[same], which[same]
    raw = w.low
    ok = np.zeros(len(start), bool)
    for i, (s, q) in enumerate(zip(start.tolist(), which.tolist(), strict=True)):
        ok[i] = p.text[q] == b" ".join(raw[x:y].tobytes() for x, y in zip(w.start[s : s + m].tolist(), w.end[s : s + m].tolist(), strict=True))
    return start[ok], which[ok]


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_from", T.ArrayType(T.LongType())),
    T.StructField("hit_to", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1) if len(s) else np.zeros(0, int)
    return s[new], e[last]


def mark_occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """`docs` with n_words, hit_from / hit_to (merged word ranges, ends excluded), items (ids as strings, sorted).

    All columns of `docs` pass through.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    out = docs
    for b in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        rows = own.collect()  # block_bytes of text on average
        names = [r["item"] for r in rows]
        table = [compile_patterns(n, found) for n, found in windows_of(pa.array([r["text"] for r in rows], pa.string()), window).items()]
        out = _pass(out, table, names, text_col, carry=b > 0)
        if n_blocks > 1 and b % 4 == 3:
            out = saved(out)  # bounds the workers that stand behind one another in a task
    return out


def _pass(docs: DataFrame, patterns: list[Patterns], names: list[str], text_col: str, carry: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((patterns, names))
    base = docs.withColumn("_before", F.struct("hit_from", "hit_to", "items")) if carry else docs

    def make():
        patterns, names = shared.value

        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n_words, lows, highs, items = [], [], [], []
            before = batch.column("_before").to_pylist() if carry else None
            for i, j, _, _, w in word_slices(batch.column(text_col)):
                n_words.append(np.diff(w.off))
                found = [(s, s + p.length, q, p) for p in patterns for s, q in [search(w, p)]]
                row_hits: dict[int, list] = defaultdict(list)
                for s, e, q, p in found:
                    rows = np.searchsorted(w.off, s, "right") - 1
                    for r in np.unique(rows).tolist():
                        on = rows == r
                        own = {names[o] for k in np.unique(q[on]).tolist() for o in p.owners[k]}
                        row_hits[r].append((s[on] - w.off[r], e[on] - w.off[r], own))
                for r in range(j - i):
                    hits = row_hits.get(r, [])
                    if before and before[i + r]["items"]:
                        x = before[i + r]
                        hits = [*hits, (np.array(x["hit_from"]), np.array(x["hit_to"]), set(x["items"]))]
                    if hits:
                        s, e = merge(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
                        lows.append(s.tolist())
                        highs.append(e.tolist())
                        items.append(sorted(set().union(*[h[2] for h in hits])))
                    else:
                        lows.append([])
                        highs.append([])
                        items.append([])
            total = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            longs = pa.list_(pa.int64())
            return {"n_words": pa.array(total, pa.int64()), "hit_from": pa.array(lows, longs), "hit_to": pa.array(highs, longs), "items": pa.array(items, pa.list_(pa.string()))}

        return fn

    out = append_columns(base, RESULT, make, text_col)
    return out.drop("_before") if carry else out


def n_hit():
    """Hit words from the merged ranges."""
    return F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def contaminated(share: int = 20):
    """At least one word in `share` is hit."""
    hit = n_hit()
    return (hit > 0) & (share * hit >= F.col("n_words"))
