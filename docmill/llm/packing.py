"""Sequence packing by non-negative least squares over length histograms.

Texts become token ids; whole windows are cut off long documents first, which leaves a remainder
per document. For the remainders of a block the packer enumerates every combination of one to
three lengths that fills a window exactly, solves the repeat counts against the length histogram
by non-negative least squares, rounds them by largest remainder, repeats that for the lengths left, makes exactly those windows, and packs
the residual greedily (best fit, then pieces are cut to close the last gaps).

Blocks are runs of rows of one task (`block_docs` at most), so there is no shuffle, nothing is
collected, and a lost task is redone alone with the same ids: (partition, block) number the
sequences. Only lengths and checksums of a block are held, not its ids.

Edge cases: a null text is the empty text and gives its end id alone; an empty table gives no
rows; repeated rows are packed like any others; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SLICE_BYTES, flat, lean, prefix_sums, range_hash, slices

#: Distinct pre-tokens whose ids a task keeps (about 200 bytes each); it is emptied when full.
CACHED_PIECES = 400_000


# ---------------------------------------------------------------- token ids


class PieceEncoder:
    """Byte-level BPE of a tokenizer file, made fast by encoding each distinct pre-token once.

    Texts of ASCII and Latin letters are split into pre-tokens with numpy by the tokenizer's
    splitting rule, and each distinct pre-token is merged by `ranks_path` (the same vocabulary as
    merge ranks, which costs a third of the time); any other text, texts with an apostrophe
    (contractions) and texts that hold an added token's content go through the tokenizer whole. Without ranks all texts do.
    """

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.merge = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, bytes] = {}
        # classes of bytes: 1 letter, 2 digit, 3 white space, 4 other, 5 needs the tokenizer itself
        kind = np.full(256, 4, np.uint8)
        kind[ord("a") : ord("z") + 1] = kind[ord("A") : ord("Z") + 1] = 1
        kind[ord("0") : ord("9") + 1] = 2
        kind[[9, 10, 11, 12, 13, 32]] = 3
        kind[:9] = kind[14:32] = kind[127] = kind[ord("'")] = 5
        kind[0x80:] = 5
        kind[0xC3:0xCA] = 1  # lead bytes of U+00C0..U+027F, letters but for two signs
        kind[0x80:0xC0] = 1  # continuation bytes
        self.kind = kind

    def plain(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows that numpy may split."""
        bad = self.kind[data] == 5
        sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) if len(data) > 1 else np.zeros(0, bool)
        bad[:-1] |= sign
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                bad[at] = True
                at = raw.find(token, at + 1)
        seen = np.concatenate(([0], np.cumsum(bad)))
        return (seen[offs[1:]] == seen[offs[:-1]]) & (self.merge is not None)

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens: optional space then a run of one class; white space before it apart."""
        n, kind = len(data), self.kind[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.concatenate(([0], kind[:-1]))
        before[first[:n]] = 0
        after = np.concatenate((kind[1:], [0]))
        after[first[1:]] = 0
        space = kind == 3
        gap = np.concatenate(([False], (data == 32)[:-1])) & ~first[:n]  # a space stands before
        at = np.zeros(n, bool)
        run = ~space & (kind != before)
        at[run & ~gap] = True
        at[np.flatnonzero(run & gap) - 1] = True
        at[space & (before != 3)] = True
        at[space & (after != 3) & (after != 0)] = True
        return np.flatnonzero(at)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, its ids as little-endian unsigned 32-bit) in order."""
        data, offs = flat(column)
        for i, j in slices(offs, SLICE_BYTES // 2):  # numpy takes dozens of bytes for one of text
            own, part = offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
            fine = self.plain(part, own)
            done: list[bytes] = self._split(part, own) if fine.any() else [b""] * (j - i)
            rest = np.flatnonzero(~fine)
            if len(rest):
                texts = [part[own[k] : own[k + 1]].tobytes().decode("utf-8", "replace") for k in rest]
                for k, e in zip(rest, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    done[k] = np.array(e.ids, "<u4").tobytes()
            for k in range(j - i):
                yield i + k, done[k]

    def _split(self, part: np.ndarray, own: np.ndarray) -> list[bytes]:
        start = self.starts(part, own)
        if not len(start):
            return [b""] * (len(own) - 1)
        end = np.append(start[1:], len(part))
        which, _ = pd.factorize(range_hash(prefix_sums(part), start, end))
        at = np.flatnonzero(np.maximum.accumulate(np.concatenate(([-1], which[:-1]))) < which)  # first occurrences
        raw, known = part.tobytes(), self.cache
        if len(known) > CACHED_PIECES:
            known.clear()
        pieces = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        ids = [known.get(p) for p in pieces]
        for k, found in enumerate(ids):
            if found is None:
                ids[k] = known[pieces[k]] = array("I", self.merge(pieces[k])).tobytes()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, base = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        count = size[which]
        to = np.cumsum(count)
        take = np.repeat(base[which] - (to - count), count) + np.arange(to[-1])
        flat_ids = pool[take].tobytes()
        cut = np.concatenate(([0], to))[np.searchsorted(start, own)] * 4
        return [flat_ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


# ---------------------------------------------------------------- combinations and repeat counts


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All (a <= b <= c) of present lengths with a + b + c == window; a or b may be 0 (absent)."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    lengths = np.concatenate(([0], np.flatnonzero(have)))
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & (c > 0)
    ok &= np.where(ok, have[np.clip(c, 0, window)], False)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, close: float = 0.25, rounds: int = 4000) -> np.ndarray:
    """x >= 0 with the least squares |use of lengths by x - histogram|, by coordinate descent on disjoint columns.

    Each round takes the combinations with the largest exact line steps, no two of which share a length, so their
    steps do not disturb each other. It ends when no step reaches `close` of a window. The largest steps come first, so few
    combinations hold most of the counts and rounding loses little.
    """
    n = len(combos)
    have = combos > 0
    # squared norm of a column: a length used k times counts k * k
    twice = ((combos[:, 0] == combos[:, 1]) & have[:, 0]).astype(int) + ((combos[:, 1] == combos[:, 2]) & have[:, 1])
    norm = have.sum(1) + 2 * twice + 2 * (twice == 2)
    x = np.zeros(n)
    left = histogram.astype(float)
    left[0] = 0
    a, b, c = combos.T
    for _ in range(rounds):
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -x)
        size = np.abs(step)
        large = np.flatnonzero(size >= max(close, size.max() / 2))
        if not len(large):
            break
        large = large[np.argsort(-size[large], kind="stable")]
        first = np.full(len(left), n)
        place = np.arange(len(large))
        for side in (a, b, c):
            np.minimum.at(first, side[large], place)
        first[0] = n
        free = np.ones(len(large), bool)
        for side in (a, b, c):
            free &= (side[large] == 0) | (first[side[large]] == place)
        go = large[free]
        x[go] += step[go]
        for side in (a, b, c):
            np.subtract.at(left, side[go], step[go])
        left[0] = 0
    return x


def rounded(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts by largest remainder: floors, then one more in order of the remainders until their sum is reached, as far as lengths are left."""
    left = histogram.copy()
    left[0] = np.iinfo(np.int64).max // 4
    times = np.zeros(len(x), np.int64)

    def take(k: int, most: int) -> int:
        sizes, counts = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(most, (left[sizes] // counts).min()))
        left[sizes] -= n * counts
        times[k] += n
        return n

    for k in np.argsort(-x, kind="stable")[: int((x >= 1).sum())].tolist():
        take(k, int(x[k]))
    rest, missing = x - np.floor(x), round(float(x.sum())) - int(times.sum())
    for k in np.argsort(-rest, kind="stable")[: int((rest > 0).sum())].tolist():
        if missing <= 0:
            break
        missing -= take(k, 1)
    return times


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often each combination is made: solved and rounded, then again for the lengths that rounding has left, while that adds a fiftieth."""
    times, left = np.zeros(len(combos), np.int64), histogram.copy()
    while True:
        more = rounded(solve_counts(combos, left), combos, left)
        times += more
        for side in combos.T:
            np.subtract.at(left, side, more)
        left[0] = 0
        if 50 * more.sum() <= times.sum():
            return times


class Packer:
    """Packs lengths below a window into sequences: yields (sequence, piece, taken from, taken)."""

    def __init__(self, window: int) -> None:
        self.window = window

    def pack(self, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Sequences as lists of (item, first id of the item, ids); every item is used up.

        First the windows that the rounded counts name, no others; what they leave is packed greedily.
        """
        w = self.window
        order = np.argsort(lengths, kind="stable")
        histogram = np.bincount(lengths, minlength=w + 1)
        ends = np.cumsum(histogram)
        left = histogram.copy()
        out: list[list[tuple[int, int, int]]] = []

        def pop(size: int) -> int:
            left[size] -= 1
            return int(order[ends[size] - histogram[size] + left[size]])

        combos = combinations(np.unique(lengths[lengths > 0]), w)
        if len(combos):
            times = repeat_counts(combos, histogram)
            for k in np.flatnonzero(times).tolist():
                sizes = [s for s in combos[k].tolist() if s]
                out.extend([(pop(s), 0, s) for s in sizes] for _ in range(times[k]))
        out.extend(self._greedy(left, pop))
        return out

    def _greedy(self, left: np.ndarray, pop) -> list[list[tuple[int, int, int]]]:
        """Longest first into the sequence, then the longest that fits; a gap that nothing fits is closed by cutting the next."""
        w, out = self.window, []
        sizes = [s for s in range(w, 0, -1) for _ in range(int(left[s]))]
        have = np.zeros(w + 1, np.int64)
        for s in sizes:
            have[s] += 1
        rest: tuple[int, int, int] | None = None  # tail of a cut item
        n = len(sizes)
        while n or rest:
            room, sequence = w, []
            if rest:
                sequence.append(rest)
                room, rest = room - rest[2], None
            while room and n:
                fit = np.flatnonzero(have[: room + 1])
                if len(fit):
                    s = int(fit[-1])
                    have[s] -= 1
                    n -= 1
                    sequence.append((pop(s), 0, s))
                    room -= s
                else:
                    s = int(np.flatnonzero(have)[0])
                    have[s] -= 1
                    n -= 1
                    item = pop(s)
                    sequence.append((item, 0, room))
                    rest, room = (item, room, s - room), 0
            out.append(sequence)
        return out


# ---------------------------------------------------------------- operator

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    end_id: int = 0,
    block_docs: int = 20_000,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    `sequence_id` is unique over the table. Set `with_ids` to get each piece's ids themselves; a
    block then also holds its ids in memory.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = PieceEncoder(tokenizer_path, ranks_path), Packer(window)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        end = np.array([end_id], "<u4").tobytes()
        keys: list = []
        rows: list[tuple] = []  # whole windows: row number, start, length, crc, tokens
        tails: list[tuple[int, int, bytes]] = []  # row number, start, ids of the remainder

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, keys, rows, tails
            made: list[tuple] = []
            for row, start, length, crc, total, ids in rows:
                made.append((row, start, length, crc, total, sequence, 0, ids))
                sequence += 1
            sizes = np.array([len(t[2]) // 4 for t in tails], np.int64)
            for one in packer.pack(sizes) if len(sizes) else []:
                offset = 0
                for item, first, n in one:
                    row, start, ids, total = tails[item]
                    part = ids[4 * first : 4 * (first + n)]
                    made.append((row, start + first, n, zlib.crc32(part), total, sequence, offset, part))
                    offset += n
                sequence += 1
            if made:
                cols = list(zip(*made, strict=True))
                arrays = [pa.array([keys[r] for r in cols[0]], key_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[7]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            keys, rows, tails = [], [], []

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            ids_of_rows = batch.column("doc_id").to_pylist()
            for k, ids in encoder.encode(batch.column("text")):
                ids += end
                total, row = len(ids) // 4, len(keys)
                keys.append(ids_of_rows[k])
                for s in range(0, total - window + 1, window):
                    part = ids[4 * s : 4 * (s + window)]
                    rows.append((row, s, window, zlib.crc32(part), total, part if with_ids else b""))
                if total % window:
                    s = total - total % window
                    tails.append((row, s, ids[4 * s :], total))
                if len(keys) >= block_docs:
                    yield from flush()
        yield from flush()

    return base.mapInArrow(lean(run), schema)
