"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A text is the multiset of its `shingle`-word runs (lower-cased words; a text of fewer words is one
run). Every shingle owns Poisson processes over time and weight, one for each dyadic piece
[0, 1), [1, 2), [2, 4), ... of the weight axis, so weights are discretised at integers and a
larger weight only adds points. A point names one signature component at random; a component
keeps its earliest point. Two signatures agree in a component with the probability of the
weighted Jaccard similarity. Points are made in order of time only until all components are hit,
so a text costs about its length plus m log m.

1. Identical texts are collapsed; components are banded (`bands` x `rows`), and texts that share a
   band are candidates. Texts alone in all their buckets are done.
2. Each candidate is shingled once more into its bag (sorted hashes and counts) and a sketch: a second,
   longer BagMinHash signature of four bits a component, whose front part does for most comparisons.
   Sketches travel to the buckets, bags do not.
3. Leaders: in every bucket the member nearest to the bucket's commonest components leads, up to four
   times; pairs whose sketches may reach the similarity are verified by exact multiset overlap, and
   verified pairs make classes (label propagation with pointer jumping).
4. Across: in buckets that still hold several classes, each member outside the largest class meets every
   member of the others, by sketch; pairs that may reach the similarity are verified as before, each once,
   from the least of the buckets that both are in.

So every pair of different classes that shares a band is looked at and pairs within a class are not. A pair
of similarity 0.8 passes by all bands with probability 7e-6 and below a sketch's limits with 4e-7, a more
similar one less often. Buckets of more than `block` members are led in parts whose leaders meet
again, and crossed in blocks of `block` against `block`, so a task holds two blocks of sketches at most.
Nothing but counts reaches the driver.

Edge cases: null is the empty text; identical texts, wordless ones too, are one class; wordless
texts are near no other text; repeated rows each get a row; null ids get a row and are never a
class id unless the class has no other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import SLICE_BYTES, Words, append_columns, fresh_name, lean, mix, saved, small_batches, whole_groups, word_slices

_U64 = np.uint64
BANDS, ROWS, SHINGLE, SIMILARITY = 30, 5, 5, 0.8
#: Components of a sketch, those of its front part, and how many standard deviations below the similarity an estimate may lie.
SKETCH, FRONT, DEVIATIONS = 2048, 512, 5.1
#: Poisson processes whose points are made at once: memory, not results, depends on it.
PROCESSES = 8192
#: Members of a bucket that meet in one task.
BLOCK = 2048


# ---------------------------------------------------------------- shingles and signatures


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles, ordered by row."""
    n = np.diff(w.off)
    h = w.hash
    rows = np.repeat(np.arange(len(n)), n)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, _U64)
        for k in range(size):
            s = s * _U64(0x9FB21C651E98DF25) + h[k : len(h) - size + 1 + k]
        whole = rows[: len(s)] == rows[size - 1 :]
        row, key = rows[: len(s)][whole], mix(s[whole])
    else:
        row, key = np.zeros(0, np.int64), np.zeros(0, _U64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), _U64)
        for k in range(size - 1):
            on = n[short] > k
            extra[on] = extra[on] * _U64(0x9FB21C651E98DF25) + h[w.off[short[on]] + k]
        row, key = np.concatenate((row, short)), np.concatenate((key, mix(extra + _U64(1))))
    order = np.argsort((row.astype(_U64) << _U64(44)) | (key >> _U64(20)), kind="stable")
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(key)))


def draws(seed: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    return mix(seed + np.asarray(j, _U64) * _U64(0x9E3779B97F4A7C15))


def bag_min_hash(row: np.ndarray, key: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m components (uint64: time, then the point's name); rows without shingles get all ones."""
    out = np.full(n_rows * m, np.iinfo(np.uint64).max, _U64)
    # a process for each dyadic piece that the weight reaches into
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    own = np.repeat(np.arange(len(row)), levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.maximum(low, 1).astype(float)  # the piece is [low, low + span)
    seed = mix(key[own] + level.astype(_U64) * _U64(0xC2B2AE3D27D4EB4F))
    row, weight = row[own], count[own]
    total = np.bincount(row, np.minimum(weight - low, span), n_rows)
    horizon = m * (np.log(m) + 2.5) / np.maximum(total, 1e-9)
    todo = np.flatnonzero(total > 0)
    before = np.zeros(n_rows)
    time, made = np.zeros(len(row)), np.zeros(len(row), np.int64)
    active = np.arange(len(row))
    while len(todo):
        batch = 1  # one point each at first: most processes have none before the horizon
        here = active[time[active] <= horizon[row[active]]] if before.any() else active
        while len(here):
            for s in range(0, len(here), PROCESSES):
                own = here[s : s + PROCESSES]
                u = draws(seed[own][:, None], made[own][:, None] + np.arange(batch))
                gaps = -np.log(((u >> _U64(11)).astype(float) + 0.5) * 2.0**-53) / span[own][:, None]
                t = time[own][:, None] + np.cumsum(gaps, 1)
                name = mix(u ^ _U64(0x5851F42D4C957F2D))
                height = low[own][:, None] + np.floor((name >> _U64(40)).astype(float) * 2.0**-24 * span[own][:, None])
                fits = height < weight[own][:, None]
                slot = row[own][:, None] * m + ((name & _U64(0xFFFFFF)) % _U64(m)).astype(np.int64)
                packed = (t.astype(np.float32).view(np.uint32).astype(_U64) << _U64(32)) | (u >> _U64(32))
                np.minimum.at(out, slot[fits], packed[fits])
                time[own] = t[:, -1]
                made[own] += batch
            here = here[time[here] <= horizon[row[here]]]
            batch = 8
        missing = (out.reshape(n_rows, m)[todo] == np.iinfo(np.uint64).max).any(1)
        late = (out.reshape(n_rows, m)[todo] >> _U64(32)).max(1) > horizon[todo].astype(np.float32).view(np.uint32)
        todo = todo[missing | late]
        before[todo] = 1
        if len(todo):
            horizon[todo] *= 2
            again = np.zeros(n_rows, bool)
            again[todo] = True
            active = np.flatnonzero(again[row])
    return out.reshape(n_rows, m)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands."""
    s = signature.reshape(len(signature), bands, rows)
    h = np.zeros((len(signature), bands), _U64)
    for k in range(rows):
        h = mix(h * _U64(3) + s[:, :, k])
    return mix(h + np.arange(bands, dtype=_U64) * _U64(0xD1B54A32D192ED03))


def signed(docs: DataFrame, text_col: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with band_hashes (array<long>, empty for wordless texts) and n_shingles."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            hashes, sizes = [], []
            for i, j, _, _, w in word_slices(batch.column(text_col)):
                row, key, count = shingles(w, shingle)
                total = np.bincount(row, count, j - i).astype(np.int64)
                h = band_hashes(bag_min_hash(row, key, count, j - i, bands * rows), bands, rows).view(np.int64)
                hashes.extend(h[r] if total[r] else h[r, :0] for r in range(j - i))
                sizes.append(total)
            total = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            off = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))) if hashes else np.zeros(1)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            return {"band_hashes": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int64())), "n_shingles": pa.array(total, pa.int64())}

        return fn

    return append_columns(docs, [T.StructField("band_hashes", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.LongType())], make, text_col)


# ---------------------------------------------------------------- bags and sketches


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, counts)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    both = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def packed_sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each component, 16 components a word."""
    low = (mix(signature) & _U64(15)).reshape(len(signature), -1, 16)
    out = np.zeros(low.shape[:2], _U64)
    for k in range(16):
        out |= low[:, :, k] << _U64(4 * k)
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components in which packed sketches agree, along the last axis."""
    x = a ^ b
    x |= x >> _U64(1)
    x |= x >> _U64(2)
    return a.shape[-1] * 16 - np.bitwise_count(x & _U64(0x1111111111111111)).sum(-1, dtype=np.int64)


def least_agreement(similarity: float, size: int) -> int:
    """Components of `size` that texts of this similarity agree in, less the allowed deviations (a sixteenth of the others agree by chance)."""
    p = similarity + (1 - similarity) / 16
    return int(np.floor(size * p - DEVIATIONS * (size * p * (1 - p)) ** 0.5))


def bags_of(texts: DataFrame, shingle: int) -> DataFrame:
    """node, buckets (int64), n, keys (sorted uint64), counts (uint32; empty where all are 1), front (of the sketch), sketch. `texts`: node, buckets (array), text."""

    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j, _, _, w in word_slices(batch.column("text"), most=SLICE_BYTES // 8):  # sketches of short texts outweigh them
                row, key, count = shingles(w, shingle)
                order = np.lexsort((key, row))
                row, key, count = row[order], key[order], count[order]
                sketch = packed_sketch(bag_min_hash(row, key, count, j - i, SKETCH))
                cut = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                counts = [count[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes[i:j]),
                        pa.array([np.array(b, np.int64).tobytes() for b in batch.column("buckets").slice(i, j - i).to_pylist()], pa.binary()),
                        pa.array(np.bincount(row, count, j - i).astype(np.int64)),
                        pa.array([key[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([c.astype(np.uint32).tobytes() if (c > 1).any() else b"" for c in counts], pa.binary()),
                        pa.array([s[: FRONT // 16].tobytes() for s in sketch], pa.binary()),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["node", "buckets", "n", "keys", "counts", "front", "sketch"],
                )

    return texts.select("node", "buckets", "text").mapInArrow(lean(run), "node long, buckets binary, n long, keys binary, counts binary, front binary, sketch binary")


def matrix(column: pa.ChunkedArray, kind: type = _U64) -> np.ndarray:
    """Rows x values of a column of equally long byte strings."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs whose bags overlap enough."""
    side = lambda c: bags.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"), F.col("counts").alias(f"counts_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "keys_a", "counts_a", "keys_b", "counts_b")

    def bag(keys: pa.BinaryScalar, counts: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.frombuffer(keys.as_buffer(), _U64), np.frombuffer(counts.as_buffer(), np.uint32)
        return k, c.astype(np.int64) if len(c) else np.ones(len(k), np.int64)

    def run(batches):
        for batch in batches:
            cols = [batch.column(f"{c}_{side}") for side in "ab" for c in ("keys", "counts")]
            near = [overlap(bag(cols[0][k], cols[1][k]), bag(cols[2][k], cols[3][k])) >= similarity for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


# ---------------------------------------------------------------- leaders


def may_be_near(n: np.ndarray, own_n: np.ndarray, sketch: np.ndarray, own: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and sketches leave room for the similarity."""
    fits = np.minimum(n, own_n) >= similarity * np.maximum(n, own_n)
    return fits & (agreement(sketch, own) >= least_agreement(similarity, sketch.shape[1] * 16))


def middle_of(sketch: np.ndarray) -> np.ndarray:
    """The commonest value of each component."""
    out = np.zeros(sketch.shape[1], _U64)
    words = np.arange(sketch.shape[1])
    for k in range(16):
        value = ((sketch >> _U64(4 * k)) & _U64(15)).astype(np.int64)
        votes = np.bincount((words * 16 + value).ravel(), minlength=16 * len(words)).reshape(-1, 16)
        out |= votes.argmax(1).astype(_U64) << _U64(4 * k)
    return out


def lead(n: np.ndarray, sketch: np.ndarray, similarity: float, times: int = 4) -> tuple[int, np.ndarray, np.ndarray]:
    """(place of the first leader, places of leaders, places of members that may be near them) of one bucket."""
    rest, leaders, members = np.arange(len(n)), [], []
    for _ in range(times):
        if len(rest) < 2:
            break
        at = int(np.argmax(agreement(sketch[rest], middle_of(sketch[rest])))) if len(rest) > 2 else 0
        leaders.append(rest[at])
        near = may_be_near(n[rest], n[leaders[-1]], sketch[rest], sketch[leaders[-1]], similarity)
        near[at] = False
        members.append(rest[near])
        near[at] = True
        rest = rest[~near]
    sizes = [len(m) for m in members]
    return int(leaders[0]) if leaders else 0, np.repeat(np.array(leaders, np.int64), sizes), np.concatenate([*members, np.zeros(0, np.int64)])


def led(entries: DataFrame, bags: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: pairs of a leader and a member of its bucket that may be near. `entries`: bucket, node, size."""
    small_batches(entries.sparkSession)

    def run(batches):
        for whole in whole_groups(batches, ["bucket", "part"], block):
            bucket, node, n, sketch = whole["bucket"].to_numpy(), whole["node"].to_numpy(), whole["n"].to_numpy(), matrix(whole["front"])
            cut = group_edges(bucket, whole["part"].to_numpy())
            pair = cut[:-1][np.diff(cut) == 2]  # most buckets: all at once
            near = pair[may_be_near(n[pair], n[pair + 1], sketch[pair], sketch[pair + 1], similarity)]
            a, b, first = [near], [near + 1], [pair]
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if y - x != 2:
                    top, p, q = lead(n[x:y], sketch[x:y], similarity)
                    a.append(x + p)
                    b.append(x + q)
                    first.append(np.array([x + top]))
            a, b, first = np.concatenate(a), np.concatenate(b), np.concatenate(first)
            # a row without b names the leader of a part
            many = first[whole["parts"].to_numpy()[first] > 1]
            arrays = [np.concatenate((bucket[a], bucket[many])), np.concatenate((node[a], node[many]))]
            other = pa.concat_arrays([pa.array(node[b]), pa.nulls(len(many), pa.int64())])
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), other], names=["bucket", "a", "b"])

    found: DataFrame | None = None
    most = entries.agg(F.max("size")).first()[0] or 0
    while True:
        parts = F.ceil(F.col("size") / block).cast("long")
        placed = entries.select("bucket", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part")).join(bags.select("node", "n", "front"), "node")
        out = placed.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node").mapInArrow(lean(run), "bucket long, a long, b long")
        out = out if most <= block else saved(out)
        pairs = out.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if most <= block:
            return found.distinct()
        leaders = out.where("b is null").select("bucket", F.col("a").alias("node"))
        entries = saved(leaders.join(leaders.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket"))
        most = entries.agg(F.max("size")).first()[0] or 0


# ---------------------------------------------------------------- across classes


def crossed(entries: DataFrame, labels: DataFrame, bags: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: pairs of different classes that share a bucket and may be near; one of a pair is outside its bucket's largest class."""
    current = entries.select("bucket", "node").join(labels, "node")
    shares = current.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("members", "label")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("members").alias("size")).where("kinds > 1")
    of = lambda c, most: F.pmod(F.xxhash64("node"), most).alias(c)
    to = lambda c, most: F.explode(F.sequence(F.lit(0).cast("long"), most - 1)).alias(c)
    member_parts, asker_parts = F.ceil(F.col("size") / block).cast("long"), F.ceil((F.col("size") - F.col("top.members")) / block).cast("long")
    placed = current.join(mixed, "bucket").select("bucket", "node", "label", (F.col("label") != F.col("top.label")).alias("asks"), member_parts.alias("mp"), asker_parts.alias("ap"))
    # every block of askers against every block of members; where there is one block of each, an asker's row is both
    one = (F.col("mp") == 1) & (F.col("ap") == 1)
    members = placed.select("bucket", to("i", F.col("ap")), of("j", F.col("mp")), "node", "label", (F.col("asks") & one).alias("asks"), F.lit(True).alias("answers"))
    askers = placed.where(F.col("asks") & ~one).select("bucket", of("i", F.col("ap")), to("j", F.col("mp")), "node", "label", "asks", F.lit(False).alias("answers"))
    rows = members.unionByName(askers).join(bags.select("node", "buckets", "n", "sketch"), "node")
    small_batches(entries.sparkSession)

    def run(batches):
        for whole in whole_groups(batches, ["bucket", "i", "j"], block):
            node, n, label, bucket = (whole[c].to_numpy() for c in ("node", "n", "label", "bucket"))
            asks, answers = whole["asks"].to_numpy(), whole["answers"].to_numpy()
            sketch, buckets = matrix(whole["sketch"]), matrix(whole["buckets"], np.int64)
            front = np.ascontiguousarray(sketch[:, : FRONT // 16])
            cut = group_edges(bucket, whole["i"].to_numpy(), whole["j"].to_numpy())
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                others = x + np.flatnonzero(answers[x:y])
                for k in x + np.flatnonzero(asks[x:y]):
                    to = others[label[others] != label[k]]
                    to = to[~(asks[to] & (node[to] < node[k]))]  # two askers of a block meet once
                    to = to[may_be_near(n[to], n[k], front[to], front[k], similarity)]
                    to = to[may_be_near(n[to], n[k], sketch[to], sketch[k], similarity)]
                    shared = np.where(buckets[to] == buckets[k], buckets[to], np.iinfo(np.int64).max)
                    to = to[shared.min(1, initial=np.iinfo(np.int64).max) == bucket[x]]
                    a.append(np.minimum(node[k], node[to]))
                    b.append(np.maximum(node[k], node[to]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(lean(run), "a long, b long")


def group_edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(keys[0])])) if len(keys[0]) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- classes


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its class) of all nodes in `links` (a, b). Label propagation with pointer jumping."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct()
    both = saved(both)
    labels = saved(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = saved(lower.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("far"), "label").select("node", F.least("far", "label").alias("label"), (F.least("far", "label") != F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").limit(1).count() == 0:
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (a, b) have joined their classes; only the classes touched are looked at."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    new = components(between).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return saved(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(texts, rows): per distinct text text_key, first_id, class_id, leads; per document id, text_key, class_id.

    `leads` marks the one distinct text that stands for its class (the one with the least id).
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = signed(keyed, "text", bands, rows, shingle).drop("text")
    # any copy's signature will do: identical texts have identical ones
    nodes = prints.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("band_hashes").alias("band_hashes"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select(F.explode("band_hashes").alias("bucket"), "node")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = saved(entries.join(buckets, "bucket"))  # only buckets of two or more
    wanted = entries.select("node").distinct().join(nodes.select("node", "text_key", F.col("band_hashes").alias("buckets")), "node")
    # one text for each candidate node: copies are dropped by key
    texts = keyed.select("text_key", "text").join(wanted, "text_key").groupBy("node").agg(F.first("buckets").alias("buckets"), F.first("text").alias("text"))
    bags = saved(bags_of(texts, shingle))
    links = saved(verified(led(entries, bags, similarity, block), bags, similarity))
    labels = relabelled(bags.select("node", F.col("node").alias("label")), links)
    links = saved(verified(crossed(entries, labels, bags, similarity, block), bags, similarity))
    labels = relabelled(labels, links)
    grouped = nodes.join(labels, "node", "left").select("text_key", "first_id", "node", F.coalesce("label", "node").alias("label"))
    heads = grouped.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("head"))
    named = grouped.join(heads, "label").select("text_key", "first_id", "class_id", (F.col("node") == F.col("head.node")).alias("leads"))
    return named, keyed.select("doc_id", "text_key").join(named.select("text_key", "class_id"), "text_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the least id; all columns pass through.

    Of rows with this id and text, the one whose other columns come first as JSON stays.
    """
    key, first, whole = (fresh_name(docs, n) for n in ("key", "first", "whole"))
    named, _ = classes(docs, id_col=id_col, text_col=text_col, **options)
    stays = named.where("leads").select(F.col("text_key").alias(key), F.col("first_id").alias(first))
    mine = docs.withColumn(key, text_key(F.col(text_col))).join(stays, key).where(F.col(id_col).eqNullSafe(F.col(first)))
    rest = F.to_json(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in {id_col, text_col}]))
    return mine.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rest).alias(whole)).select(f"{whole}.*")
