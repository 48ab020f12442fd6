"""Removal of repeated substrings by a hash-compared suffix sort.

Every byte covered by a `window`-byte string that also starts elsewhere (same text or another) is
removed. Two equal windows hold equal `gram`-byte pieces, so each window is filed under its
minimizer: the least hash among its grams, the leftmost of equals. A run is the stretch of
neighbouring windows with one minimizer, about one row for every 80 bytes of text:

1. Texts are collapsed by SHA-256; a text with copies is removed whole but still counts elsewhere.
2. Runs are counted by minimizer. A minimizer seen once has no repeat. Runs are the same if a 128-bit
   BLAKE2 digest of their bytes and the minimizer's place are; where all runs of a minimizer are the same, all
   their windows are repeats, and so are those of every run that occurs twice.
3. Of other minimizers, one copy of each distinct run is fetched. The run's bytes from the minimizer on are
   a suffix, those before it, read backwards, another. Prefix polynomial hashes and binary search give the common
   extension of two suffixes in log(window) probes, a mergesort places them, and the extension of every two
   neighbours is then compared byte by byte; should a hash have lied, the block is sorted by its bytes.
   Windows at one distance from the minimizer are equal if their suffixes stand in one block both ways, so
   single windows are never compared.
4. Minimizers with more than `group_runs` distinct runs are split, not gathered: by halves of the
   distance, with the bytes that all windows of a half hold as a longer minimizer, and again until groups fit. Where
   that comes down to a single distance, all a run has left is one window, and equal ones are counted by their bytes.

No step gathers a key's rows: counts have partial sums, and the joins are plain ones that AQE can
split. A task holds a slice of text and some `group_runs` runs.

Edge cases: null is the empty text; texts shorter than the window lose bytes to nothing; repeated
rows are copies; matches never cross texts; what is kept may end inside a character; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import merge
from .textkit import append_columns, flat, mix, prefix_sums, range_hash, released, saved, saved_by_key, slices, whole_groups

_U64 = np.uint64
WINDOW, GRAM = 200, 40
SEGMENT = 1 << 19


# ---------------------------------------------------------------- minimizers


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, gram hash, run's digest in two halves, first window, minimizer's distance from it, windows - 1) of a slice below 1 MB."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, _U64, _U64, _U64, np.int64, np.int64, np.int64))
    if len(data) < window:
        return empty
    n = len(data) - gram + 1
    at = np.arange(n)
    h = range_hash(prefix_sums(data), at, at + gram)
    low = sliding_min((h & ~_U64(0xFFFFF)) | at.astype(_U64), window - gram + 1)
    sizes = np.diff(offs)
    fits = np.zeros(len(data) + 1, np.int32)
    long_rows = np.flatnonzero(sizes >= window)
    np.add.at(fits, offs[long_rows], 1)
    np.add.at(fits, offs[long_rows + 1] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(fits)[: len(low)])
    if not len(start):
        return empty
    place = (low[start] & _U64(0xFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    a, b, p = start[first], start[np.append(first[1:] - 1, len(start) - 1)], place[first]
    raw, digest = memoryview(data.tobytes()), hashlib.blake2b
    halves = np.frombuffer(b"".join([digest(raw[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), (b + window).tolist(), strict=True)]), _U64).reshape(-1, 2)
    return np.searchsorted(offs, a, "right") - 1, h[p], halves[:, 0] ^ mix((p - a + 1).astype(_U64)), halves[:, 1], a, p - a, b - a


def pack_run(a: np.ndarray, rel: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (a << 32) | (rel << 16) | more


def minimizer_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """node, gram (hash), run and proof (halves of the digest), at (first window, minimizer's distance, windows - 1, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j, data, offs in unpacked(batch.column("packed")):
                rows, bases, cuts = segments(offs, window)
                for k, m in slices(np.concatenate(([0], np.cumsum(cuts[:, 1] - cuts[:, 0]))), SEGMENT):
                    part = np.concatenate([data[x:y] for x, y in cuts[k:m].tolist()])
                    own = np.concatenate(([0], np.cumsum(cuts[k:m, 1] - cuts[k:m, 0])))
                    r, g, h, proof, a, rel, more = runs_of(part, own, window, gram)
                    first = a - own[r] + bases[k:m][r]
                    arrays = [pa.array(nodes[i + rows[k:m][r]]), pa.array(g.view(np.int64)), pa.array(h.view(np.int64)), pa.array(proof.view(np.int64)), pa.array(pack_run(first, rel, more))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["node", "gram", "run", "proof", "at"])

    return texts.select("node", "packed").mapInArrow(run, "node long, gram long, run long, proof long, at long")


def segments(offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the row, [from, to)) of pieces below half a megabyte; every window starts in exactly one."""
    rows, bases, cuts = [], [], []
    for r in range(len(offs) - 1):
        a, b = int(offs[r]), int(offs[r + 1])
        for s in range(a, max(a + 1, b - window + 1), SEGMENT - window):
            rows.append(r)
            bases.append(s - a)
            cuts.append((s, min(b, s + SEGMENT - 1)))
    return np.array(rows, np.int64), np.array(bases, np.int64), np.array(cuts, np.int64).reshape(-1, 2)


# ---------------------------------------------------------------- packed texts


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with the text as Zstandard bytes instead: less to shuffle and to keep."""

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6).compress

        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            data, offs = flat(batch.column(text_col))
            raw, cut = data.tobytes(), offs.tolist()
            return {"packed": pa.array([squeeze(raw[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())}

        return fn

    return append_columns(docs, [T.StructField("packed", T.BinaryType())], make, text_col).drop(text_col)


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) in slices of some 4 MB."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    i, texts, size = 0, [], 0
    for k in range(len(column)):
        texts.append(expand(column[k].as_py()))
        size += len(texts[-1])
        if size >= 4 << 20 or k == len(column) - 1:
            offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            yield i, k + 1, np.frombuffer(b"".join(texts), np.uint8), offs
            i, texts, size = k + 1, [], 0


# ---------------------------------------------------------------- suffix sort


class Suffixes:
    """Byte strings of a buffer, [at, at + length), compared by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        self.data, self.at, self.length = data, at, length
        self.sums = prefix_sums(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the strings x and y, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        a, b = self.at[x], self.at[y]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = range_hash(self.sums, a, a + mid) == range_hash(self.sums, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether x sorts before y (False where equal)."""
        n = self.common(x, y)
        more = n < self.length[y]
        out = more & (n == self.length[x])
        both = np.flatnonzero(more & (n < self.length[x]))
        out[both] = self.data[self.at[x[both]] + n[both]] < self.data[self.at[y[both]] + n[both]]
        return out

    def same_bytes(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Whether the first n bytes of all x and y are equal, by direct comparison."""
        for i in range(0, len(n), 4096):
            k = n[i : i + 4096]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            if (self.data[np.repeat(self.at[x[i : i + 4096]], k) + step] != self.data[np.repeat(self.at[y[i : i + 4096]], k) + step]).any():
                return False
        return True

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order within groups, which come in blocks; common extension with the one before, -1 where a group begins)."""
        order = merge_sort(self, group)
        first = np.concatenate(([True], group[1:] != group[:-1]))
        rest = np.flatnonzero(~first)
        lcp = np.full(len(group), -1)
        x, y = order[rest - 1], order[rest]
        lcp[rest] = self.common(x, y)
        if self.same_bytes(x, y, lcp[rest]):
            return order, lcp
        # two different strings with one hash: this block is placed by its bytes
        text = [self.data[a : a + n].tobytes() for a, n in zip(self.at.tolist(), self.length.tolist(), strict=True)]
        order = np.array(sorted(range(len(text)), key=lambda k: (group[k], text[k])), np.int64)
        for k in rest.tolist():
            u, v = text[order[k - 1]], text[order[k]]
            lcp[k] = next((i for i, (p, q) in enumerate(zip(u, v, strict=False)) if p != q), min(len(u), len(v)))
        return order, lcp


def merge_sort(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes, sorted within each group (given in blocks); all groups merge at once."""
    n = len(group)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    base, length = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(n)
    width = 1
    while width < (size.max() if n else 0):
        live = np.flatnonzero(length > width)  # slots in groups that still have two parts
        local = live - base[live]
        part = local // width
        left = part % 2 == 0
        # the sibling part of each slot, and its rank there by binary search
        top = base[live] + length[live]
        start = np.minimum(base[live] + np.where(left, part + 1, part - 1) * width, top)
        lo, hi = start.copy(), np.minimum(start + width, top)
        own = order[live]
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go]) // 2
            other = order[mid]
            # left parts count strictly smaller siblings, right parts those not larger: a stable merge
            before = np.where(left[go], suffixes.less(other, own[go]), ~suffixes.less(own[go], other))
            lo[go], hi[go] = np.where(before, mid + 1, lo[go]), np.where(before, hi[go], mid)
        moved = order.copy()
        moved[base[live] + (part - np.where(left, 0, 1)) * width + local % width + lo - start] = own
        order = moved
        width *= 2
    return order


def repeats_in(data: np.ndarray, offs: np.ndarray, group: np.ndarray, rel: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of the windows of each run that occur twice in its group; -1 where none does.

    Runs are data[offs[i]:offs[i + 1]], groups come in blocks, and of a run's windows those at distances
    low..high before its minimizer (at rel) are asked for.
    """
    n = len(rel)
    least, most = np.full(n, -1), np.full(n, -1)
    place = offs[:-1] + rel
    ahead = Suffixes(data, place, offs[1:] - place).sorted(group)
    back = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - place, rel).sorted(group)
    block = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for d in range(int(low.min(initial=window)), int(high.max(initial=-1)) + 1):
        at = np.flatnonzero((low <= d) & (d <= high))
        for to, (order, lcp), need in ((block[0], ahead, window - d), (block[1], back, d)):
            to[order] = np.cumsum(lcp < need)
        key = block[0][at] * (n + 1) + block[1][at]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        hit = at[twice]
        least[hit] = np.where(least[hit] < 0, d, least[hit])
        most[hit] = d
    return least, most


# ---------------------------------------------------------------- stages


def keyed(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` of nodes by text_key instead."""
    return rows.join(texts.select("node", "text_key"), "node").drop("node")


RUN = ["gram", "run", "proof"]
CONTENT = "gram long, run long, proof long, copies long, rel long, low long, high long, body binary, part long, n long"


def run_contents(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """CONTENT of the wanted runs (node, gram, run, proof, at, copies, n): low, high are the distances of their windows, part is the group, of n runs."""
    listed = wanted.groupBy("node").agg(F.collect_list(F.struct(*RUN, "at", "copies", "n")).alias("list"))
    joined = texts.select("text_key", "packed").join(keyed(texts, listed), "text_key").select("packed", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(batch.num_rows):
                text = expand(batch.column("packed")[k].as_py())
                items = batch.column("list").slice(k, 1).flatten()
                cols = {f: items.field(f) for f in (*RUN, "copies", "n")}
                at = items.field("at").to_numpy(zero_copy_only=False)
                a, rel, more = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
                bodies = [text[x : x + m + window] for x, m in zip(a.tolist(), more.tolist(), strict=True)]
                cols |= {"rel": pa.array(rel), "low": pa.array(rel - more), "high": pa.array(rel), "body": pa.array(bodies, pa.binary()), "part": cols["gram"]}
                yield pa.RecordBatch.from_arrays([cols[c.split()[0]] for c in CONTENT.split(", ")], names=[c.split()[0] for c in CONTENT.split(", ")])

    return joined.mapInArrow(run, CONTENT)


def divided(contents: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """The runs again by smaller groups: intervals of `width` distances, each with the bytes that all its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column("body"))
            rel, low, high, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rel", "low", "high", "part"))
            sums, place = prefix_sums(data), offs[:-1] + rel
            for i in range(-(-(window - gram + 1) // width)):
                x, y = i * width, (i + 1) * width - 1
                at = np.flatnonzero((low <= y) & (high >= x))
                if not len(at):
                    continue
                deep = np.minimum(y, window - gram)
                shared = range_hash(sums, place[at] - x, place[at] + window - deep)
                key = mix(part[at].view(_U64) + mix(shared + _U64(i)))
                back = np.minimum(rel[at], deep)
                bodies = [data[p - b : p + e].tobytes() for p, b, e in zip(place[at].tolist(), back.tolist(), np.minimum(offs[at + 1] - place[at], window - x).tolist(), strict=True)]
                new = {"rel": pa.array(back), "low": pa.array(np.maximum(low[at], x)), "high": pa.array(np.minimum(high[at], deep)), "body": pa.array(bodies, pa.binary()), "part": pa.array(key.view(np.int64))}
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in rows.schema.names], names=rows.schema.names)

    parts = saved(contents.mapInArrow(run, CONTENT).drop("n"))
    sizes = saved(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # a run alone in its group has no repeat there
    return saved(parts.join(sizes, "part").select(*contents.columns))


def equal_windows(contents: DataFrame) -> DataFrame:
    """As `settled`, of runs that are down to one window: equal bytes are counted with partial sums."""
    twice = contents.groupBy("part", "body").agg(F.count(F.lit(1)).alias("windows")).where("windows > 1").select("part", "body")
    return contents.where("copies = 1").join(twice, ["part", "body"]).select(*RUN, F.col("low").alias("least"), F.col("high").alias("most"))


def settled(contents: DataFrame, window: int, group_runs: int) -> DataFrame:
    """gram, run, proof, low, high: the repeated byte range of runs that occur once (the windows of a run overlap, so there is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["part"], group_runs):
            part = whole["part"].to_numpy()
            for i, j in blocks(part, group_runs):
                own = whole.slice(i, j - i)
                rel, low, high = (own[c].to_numpy() for c in ("rel", "low", "high"))
                data, offs = flat(own["body"])
                least, most = repeats_in(data, offs, np.unique(part[i:j], return_inverse=True)[1], rel, low, high, window)
                hit = np.flatnonzero((least >= 0) & (own["copies"].to_numpy() == 1))
                # bodies may have been cut on the left since: distances, not places in the body, are kept
                yield pa.RecordBatch.from_arrays([own[c].combine_chunks().take(pa.array(hit)) for c in RUN] + [pa.array(least[hit]), pa.array(most[hit])], names=[*RUN, "least", "most"])

    return contents.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, "gram long, run long, proof long, least long, most long")


def blocks(gram: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Whole groups together, some `most` rows at a time."""
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
    i = 0
    while i < len(gram):
        k = int(np.searchsorted(ends, i + most, "right")) - 1
        j = int(ends[k]) if k >= 0 and ends[k] > i else int(ends[np.searchsorted(ends, i, "right")])
        yield i, j
        i = j


def repeated_substrings(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_runs: int = 8192) -> DataFrame:
    """Per distinct text: text_key (SHA-256), n_bytes, span_from, span_to (maximal removed runs), kept (bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = packed(docs.select(key_of(text).alias("text_key"), text.alias("text")), "text")
    texts = squeezed.groupBy("text_key").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
    # the bytes stay where they are from here on: only keys and small rows move to them
    texts = saved_by_key(texts.withColumn("node", F.monotonically_increasing_id()))
    released(docs.sparkSession)
    runs = minimizer_runs(texts, window, gram)
    ends = [f(c).alias(f"{n}_{c}") for c in ("run", "proof") for n, f in (("low", F.min), ("high", F.max))]
    mixed = (F.col("low_run") != F.col("high_run")) | (F.col("low_proof") != F.col("high_proof"))
    seen = saved(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1").select("gram", mixed.alias("mixed")))
    found = saved(runs.join(seen, "gram"))
    released(docs.sparkSession)
    distinct = found.where("mixed").groupBy(*RUN).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("node", "at")).alias("one"))
    distinct = saved(distinct.select(*RUN, "copies", "one.node", "one.at"))
    sizes = saved(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    contents, ranges, width = run_contents(texts, distinct.join(sizes, "gram"), window), [], window - gram + 1
    while width > 1 and (contents if ranges else sizes).where(F.col("n") > group_runs).limit(1).count():
        contents = contents if ranges else saved(contents)
        ranges.append(settled(contents.where(F.col("n") <= group_runs), window, group_runs))
        width = (width + 1) // 2
        contents = divided(contents.where(F.col("n") > group_runs), window, gram, width)
    if width == 1:
        ranges.append(equal_windows(contents.where(F.col("n") > group_runs)))
        contents = contents.where(F.col("n") <= group_runs)
    ranges.append(settled(contents, window, group_runs))
    once = reduce(DataFrame.unionByName, ranges).groupBy(*RUN).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    once = saved(once)
    released(docs.sparkSession)
    first, rel, more = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF), F.col("at").bitwiseAND(0xFFFF)
    twice = distinct.where("copies > 1").select(*RUN, F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))
    kept = found.where("mixed").join(once.unionByName(twice), RUN).unionByName(found.where("not mixed"), allowMissingColumns=True)
    begin, end = F.coalesce(first + rel - F.col("most"), first), F.coalesce(first + rel - F.col("least"), first + more) + window
    spans = kept.groupBy("node").agg(F.collect_list(begin.cast("int")).alias("low"), F.collect_list(end.cast("int")).alias("high"))
    joined = texts.join(keyed(texts, spans), "text_key", "left").select("text_key", "copies", "packed", "low", "high")
    return cut_out(joined, window)


def cut_out(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            for i in range(0, batch.num_rows, 256):
                out: tuple[list, ...] = ([], [], [], [], [])
                for k in range(i, min(i + 256, batch.num_rows)):
                    text = expand(batch.column("packed")[k].as_py())
                    lo, hi = batch.column("low")[k].values, batch.column("high")[k].values
                    if batch.column("copies")[k].as_py() > 1 and len(text) >= window:
                        s, e = np.array([0]), np.array([len(text)])
                    elif lo is None or not len(lo):
                        s = e = np.zeros(0, np.int64)
                    else:
                        s, e = merge(lo.to_numpy(zero_copy_only=False), hi.to_numpy(zero_copy_only=False))
                    ends = [0, *e.tolist()]
                    kept = b"".join(text[x:y] for x, y in zip(ends, [*s.tolist(), len(text)], strict=True))
                    for to, v in zip(out, (keys[k], len(text), s.tolist(), e.tolist(), kept), strict=True):
                        to.append(v)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], longs), pa.array(out[3], longs), pa.array(out[4], pa.binary())], names=["text_key", "n_bytes", "span_from", "span_to", "kept"])

    return texts.mapInArrow(run, "text_key binary, n_bytes long, span_from array<long>, span_to array<long>, kept binary")


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))

