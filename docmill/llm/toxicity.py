"""Toxicity by a convolutional text classifier trained in numpy.

A word is embedded as the sum of two hashed vectors, one of the whole word and one of its first
bytes. Filters of widths 1, 2 and 3 slide over the whole text, each keeps its maximum (ReLU), and
a linear layer turns the maxima into a score. Training is Adam on cross-entropy with gradients
sent through the maxima; the first channel starts as smoothed log-odds of the words, which spares
most of the epochs. The fit uses a bounded sample (`sample_rows`, half of each class where there
are enough) and ends with Platt calibration, corrected to the class shares of all labels, and a
threshold for each language with enough held-back rows. For languages that are too rare in the
sample, labelled rows are drawn by language, kept from training and scored where they lie.

Only the text is an input of a score; the language picks a threshold. Scoring is a narrow map.

Edge cases: null, empty and wordless texts get the score of no evidence; texts shorter than a
filter's width leave it at 0; with labels of one class or none, every score is that class's smoothed
share; languages that are rare or null use the common threshold; input columns named like the
results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import lowest_hashes, one_label, rows_of
from .textkit import append_columns, mix, prefix_sums, range_hash, released, saved, word_slices

WORD_BITS, PREFIX_BITS, PREFIX_BYTES = 17, 14, 5
WIDTHS = (1, 2, 3)


@dataclass
class ConvModel:
    words: np.ndarray  # 2**WORD_BITS x dims
    prefixes: np.ndarray  # 2**PREFIX_BITS x dims
    filters: list[np.ndarray]  # width x dims x n
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.7
    by_lang: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, pre: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Maxima of all filters for each row."""
        x = self.words[ids] + self.prefixes[pre]
        return np.concatenate([m for m, _ in self._pool(x, off)], 1)

    def _pool(self, x: np.ndarray, off: np.ndarray):
        at = 0
        rows = np.flatnonzero(np.diff(off))
        for f in self.filters:
            width, _, n = f.shape
            best = np.zeros((len(off) - 1, n), np.float32)
            z = None
            if len(x) >= width and len(rows):
                z = np.zeros((len(x), n), np.float32)
                inner = z[: len(x) - width + 1]
                for j in range(width):
                    inner += x[j : len(x) - width + 1 + j] @ f[j]
                inner += self.bias[at : at + n]
                for j in range(1, width):  # windows that would leave the row
                    edge = off[1:][np.diff(off) >= j] - j
                    z[edge] = 0
                best[rows] = np.maximum(np.maximum.reduceat(z, off[rows]), 0)
            yield best, z
            at += n

    def logits(self, ids: np.ndarray, pre: np.ndarray, off: np.ndarray) -> np.ndarray:
        return (self.pooled(ids, pre, off) @ self.out + self.out_bias) * self.scale + self.shift


def buckets(w, lut_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and prefix buckets of a slice's words."""
    ids = (mix(w.hash) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    pre = np.empty(len(ids), np.int32)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + (1 << 20), "right")))
        a, b = w.start[i], w.end[j - 1]
        short = np.minimum(w.start[i:j] + PREFIX_BYTES, w.end[i:j]) - a
        pre[i:j] = range_hash(prefix_sums(lut_bytes[a:b]), w.start[i:j] - a, short) >> np.uint64(64 - PREFIX_BITS)
        i = j
    return ids, pre


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---------------------------------------------------------------- training


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        fix = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (fix * m / (np.sqrt(v) + 1e-8)).astype(a.dtype)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, dims: int = 8, n_filters: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ConvModel:
    rng = np.random.default_rng(seed)
    model = ConvModel(
        rng.normal(0, 0.05, (1 << WORD_BITS, dims)).astype(np.float32),
        rng.normal(0, 0.05, (1 << PREFIX_BITS, dims)).astype(np.float32),
        [rng.normal(0, 0.3, (w, dims, n_filters)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, n_filters * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    for emb, k in ((model.words, 0), (model.prefixes, 1)):
        counts = np.zeros((2, len(emb)))
        for r, label in zip(rows, y, strict=True):
            counts[label, np.unique(r[k])] += 1
        odds = np.log((counts[1] + 2) / (y.sum() + 4)) - np.log((counts[0] + 2) / ((y == 0).sum() + 4))
        emb[:, 0] = np.clip(odds, -2, 4) * (0.6 if k == 0 else 0.4)
    for f in model.filters:
        f[:, 0, :2] = 1.0 / len(f)
    out_bias = np.zeros(1, np.float32)
    params = [model.words, model.prefixes, *model.filters, model.bias, model.out, out_bias]
    adam = Adam(params, rate)
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            ids = np.concatenate([rows[i][0] for i in own])
            pre = np.concatenate([rows[i][1] for i in own])
            off = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in own])))
            adam.step(gradients(model, out_bias, ids, pre, off, y[own].astype(np.float32)))
    model.out_bias = float(out_bias[0])
    return model


def gradients(model: ConvModel, out_bias: np.ndarray, ids: np.ndarray, pre: np.ndarray, off: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    x = model.words[ids] + model.prefixes[pre]
    pools = list(model._pool(x, off))
    h = np.concatenate([p for p, _ in pools], 1)
    g = ((sigmoid(h @ model.out + out_bias[0]) - y) / len(y)).astype(np.float32)
    d_words, d_pre = np.zeros_like(model.words), np.zeros_like(model.prefixes)
    d_bias, d_filters, at = np.zeros_like(model.bias), [], 0
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for f, (best, z) in zip(model.filters, pools, strict=True):
        width, _, n = f.shape
        d_f = np.zeros_like(f)
        if z is not None:
            i, k = np.nonzero((z == best[row]) & (z > 0))
            _, first = np.unique(row[i] * n + k, return_index=True)
            i, k = i[first], k[first]
            up = g[row[i]] * model.out[at + k]
            np.add.at(d_bias, at + k, up)
            for j in range(width):
                np.add.at(d_f[j].T, k, x[i + j] * up[:, None])
                back = f[j][:, k].T * up[:, None]
                np.add.at(d_words, ids[i + j], back)
                np.add.at(d_pre, pre[i + j], back)
        d_filters.append(d_f + 1e-4 * f)
        at += n
    return [d_words, d_pre, *d_filters, d_bias, (h.T @ g) + 1e-4 * model.out, np.array([g.sum()], np.float32)]


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by weighted, smoothed logistic regression."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = weight * (p - target)
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the best F1."""
    grid = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((score >= t) & (y == 1)).sum() / max(1, (score >= t).sum() + (y == 1).sum()) for t in grid])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(grid[best[len(best) // 2]])


def reserved_of_langs(docs: DataFrame, known: DataFrame, id_col: str, lang_col: str | None, back: dict[int, float], least: int) -> DataFrame | None:
    """_id, _label, _lang of labelled rows kept from training, of languages of which `back` (share by label) leaves too few.

    About `least` rows of each label, a quarter of them at most; languages with too few labels for that have none.
    """
    if not lang_col or lang_col not in docs.columns:
        return None
    lang = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang")).where(F.col("_lang").isNotNull())
    cells = known.join(lang.groupBy("_id").agg(F.min("_lang").alias("_lang")), "_id")
    sizes: dict[str, dict[int, int]] = {}
    for r in cells.groupBy("_lang", "_label").count().collect():
        sizes.setdefault(r["_lang"], {})[r["_label"]] = r["count"]
    shares = []
    for name, n in sizes.items():
        own = {k: min(0.25, 1.2 * least / v) for k, v in n.items()}
        if len(n) > 1 and sum(back[k] * v for k, v in n.items()) < 1.25 * least <= 1.13 * sum(own[k] * v for k, v in n.items()):
            shares += [(name, k, int(x * (1 << 20))) for k, x in own.items()]
    if not shares:
        return None
    # by Arrow: a list would go through Python workers of its own, which stay beside those of the SQL functions
    kinds = pa.schema([("_lang", pa.string()), ("_label", pa.int32()), ("_below", pa.int64())])
    table = docs.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*shares, strict=True), kinds, strict=True)], schema=kinds))
    drawn = cells.join(F.broadcast(table), ["_lang", "_label"]).where(F.pmod(F.xxhash64("_id", F.lit(77)), F.lit(1 << 20)) < F.col("_below"))
    return saved(drawn.select("_id", "_label", "_lang"))


def thresholds_of(docs: DataFrame, reserve: DataFrame, model: ConvModel, id_col: str, text_col: str, least: int) -> dict[str, float]:
    """Thresholds from the reserved rows; their texts are scored where they lie."""
    own = rows_of(docs.select(F.col(id_col), F.col(text_col).alias("_text")), reserve, id_col)
    rows = score(own, model, text_col="_text", lang_col=None, out="_score", out_flag="_flag").select("_lang", "_label", "_score").collect()
    out = {}
    for name in sorted({r["_lang"] for r in rows}):
        p, y = (np.array([r[c] for r in rows if r["_lang"] == name]) for c in ("_score", "_label"))
        if len(y) >= least and 0 < y.sum() < len(y):
            out[name] = best_threshold(p, y)
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str | None = "lang",
    sample_rows: int = 8000,
    threshold: float = 0.7,
    least_of_lang: int = 200,
) -> ConvModel:
    """Fits on `sample_rows` labelled rows at most; labels must already be those one may learn from."""
    known = one_label(labels, id_col, label_col)
    shares = dict(known.groupBy("_label").count().collect())
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        empty = train([], np.zeros(0, int), epochs=0)
        empty.out[:] = 0
        empty.shift = float(np.log(share / (1 - share)))
        return empty
    half = sample_rows // 2
    reserve = reserved_of_langs(docs, known, id_col, lang_col, {1: 0.2 * min(1, half / n1), 0: 0.2 * min(1, (sample_rows - min(n1, half)) / n0)}, least_of_lang)
    if reserve is not None:
        known = known.join(F.broadcast(reserve.select("_id")), "_id", "left_anti")
    picked = lowest_hashes(known.where("_label = 1"), "_id", half).unionByName(lowest_hashes(known.where("_label = 0"), "_id", sample_rows - min(n1, half)))
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    own = rows_of(docs.select(F.col(id_col), F.col(text_col).alias("_text"), lang.alias("_lang")), picked, id_col)
    rows = sorted(bucketed(own, "_text").drop("_text").collect(), key=lambda r: (str(r[id_col]), r["words"]))
    data = [(np.frombuffer(r["words"], np.int32), np.frombuffer(r["prefixes"], np.int32)) for r in rows]
    y, langs = np.array([r["_label"] for r in rows]), np.array([str(r["_lang"]) for r in rows])
    rows = None
    if len(set(y.tolist())) < 2:
        return fit(docs, labels.limit(0), id_col=id_col, text_col=text_col, label_col=label_col)
    back = np.random.default_rng(3).random(len(y)) < 0.2
    if len(set(y[back].tolist())) < 2 or len(y) < 40:
        back[:] = False
    model = train([d for d, b in zip(data, back, strict=True) if not b], y[~back])
    model.threshold = threshold
    judged = back if back.any() else ~back
    z = np.concatenate([model.logits(*data[i], np.array([0, len(data[i][0])])) for i in np.flatnonzero(judged)])
    seen = y[judged]
    weight = np.where(seen == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    model.scale, model.shift = platt(z, seen, weight / weight.mean())
    score = sigmoid(model.scale * z + model.shift)
    for name in set(langs[judged].tolist()) - {"None"}:
        on = langs[judged] == name
        if on.sum() >= least_of_lang and 0 < seen[on].sum() < on.sum():
            model.by_lang[name] = best_threshold(score[on], seen[on])
    del data
    if reserve is not None:
        model.by_lang |= thresholds_of(docs, reserve, model, id_col, text_col, least_of_lang)
    released(docs.sparkSession)
    return model


def bucketed(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with the buckets of all words of the text (int32 as bytes): words, prefixes."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            words, prefixes = [], []
            for i, j, _, _, w in word_slices(batch.column(text_col)):
                ids, pre = buckets(w, w.low)
                for r in range(j - i):
                    words.append(ids[w.off[r] : w.off[r + 1]].tobytes())
                    prefixes.append(pre[w.off[r] : w.off[r + 1]].tobytes())
            return {"words": pa.array(words, pa.binary()), "prefixes": pa.array(prefixes, pa.binary())}

        return fn

    return append_columns(docs, [T.StructField("words", T.BinaryType()), T.StructField("prefixes", T.BinaryType())], make, text_col)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: ConvModel, *, text_col: str = "text", lang_col: str | None = "lang", out: str = "score", out_flag: str = "toxic_by_lang") -> DataFrame:
    """`docs` with the score (0 to 1) and the verdict at the language's threshold. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            parts = [model.logits(*buckets(w, w.low), w.off) for _, _, _, _, w in word_slices(batch.column(text_col))]
            p = sigmoid(np.concatenate(parts).astype(float)) if parts else np.zeros(0)
            return {out: pa.array(p, pa.float64())}

        return fn

    scored = append_columns(docs, [T.StructField(out, T.DoubleType())], make, text_col)
    cut = F.lit(model.threshold)
    if lang_col and lang_col in docs.columns and lang_col != out:
        for name, t in sorted(model.by_lang.items()):
            cut = F.when(F.col(lang_col) == name, F.lit(t)).otherwise(cut)
    return scored.withColumn(out_flag, F.col(out) >= cut)
