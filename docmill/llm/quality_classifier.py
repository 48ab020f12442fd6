"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are all that is learnt from; negatives are
never shown. A small network on surface statistics of the whole text minimises the non-negative
unbiased risk with the sigmoid loss,

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

where a step whose second term would be negative climbs on that term instead. The class prior is estimated
from a first positive-against-unlabelled fit: the least ratio of the shares of unlabelled and of
positive texts above a score, with a binomial margin.

The fit uses `sample_rows` positives and twice as many unlabelled texts at most, of which only
the statistics reach the driver. Labels, language, source and ids are no inputs of a score.

Edge cases: null and empty texts have statistics of 0 and are scored like any text; without
positives every score is 0.5; repeated rows get equal scores; input columns named like the results
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import lowest_hashes, one_label, rows_of
from .textkit import append_columns, blank_table, flat, mix, prefix_sums, range_hash, slices, spans, words
from .toxicity import Adam, sigmoid

BLANK = blank_table()
LINE = np.arange(256, dtype=np.uint8)
LINE[[0, 10]] = 0


def byte_classes() -> list[np.ndarray]:
    """Membership tables of the counted byte classes."""
    out = []
    for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"!?", b"|", b".,;:", b"\n", b" \t", bytes(range(0x80, 256)), b"{}[]()=/\\_@"):
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        out.append(table)
    return out


CLASSES = byte_classes()
N_FEATURES = len(CLASSES) + 9


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def distinct(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Distinct values of each row."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = np.sort((row << np.uint64(44)) | (mix(hashes) >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(off) - 1).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """Rows x N_FEATURES of the whole texts."""
    data, offs = flat(column)
    out = [np.zeros((0, N_FEATURES))]
    for i, j in slices(offs):
        own, part = offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        w = words(part, own, BLANK)
        n, size = np.diff(w.off).astype(float), np.diff(own).astype(float)
        n1, s1 = np.maximum(n, 1), np.maximum(size, 1)
        cols = [row_sums(t[part], own) / s1 for t in CLASSES]
        length = (w.end - w.start).astype(float)
        row = np.repeat(np.arange(j - i), np.diff(w.off))
        again = np.zeros(len(w.hash), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        three = mix(w.hash[2:] + w.hash[1:-1] * np.uint64(3)) + w.hash[:-2] * np.uint64(7)
        inside = np.flatnonzero(row[2:] == row[:-2])  # windows of one text: its neighbours in the slice must not matter
        a, b = spans(LINE[part], own)
        line_off = np.searchsorted(a, own)
        lines = np.diff(line_off).astype(float)
        line_hash = range_hash(prefix_sums(part), a, b)
        longest = np.zeros(j - i)
        np.maximum.at(longest, row, length)
        cols += [
            np.log1p(n) / 10,
            np.bincount(row, length, j - i) / n1 / 10,
            distinct(w.hash, w.off) / n1,
            row_sums(again, w.off) / n1,
            distinct(three[inside], np.searchsorted(row[inside], np.arange(j - i + 1))) / n1,
            1 - distinct(line_hash, line_off) / np.maximum(lines, 1),
            np.log1p(longest) / 5,
            np.log1p(size) / 15,
            np.log1p(n / np.maximum(lines, 1)) / 8,
        ]
        out.append(np.stack(cols, 1))
    return np.concatenate(out)


# ---------------------------------------------------------------- model


@dataclass
class PUModel:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.normal(x) @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)


def new_model(x: np.ndarray, prior: float, width: int, rng: np.random.Generator) -> PUModel:
    n = x.shape[1]
    return PUModel(x.mean(0), x.std(0) + 1e-3, rng.normal(0, 1 / n**0.5, (n, width)), np.zeros(width), rng.normal(0, 1 / width**0.5, width), np.zeros(1), prior)


def backward(model: PUModel, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of the parameters, given the loss's slope at each logit."""
    v = model.normal(x)
    h = np.tanh(v @ model.hidden + model.hidden_bias)
    up = slope[:, None] * model.out * (1 - h * h)
    return [v.T @ up, up.sum(0), h.T @ slope, np.array([slope.sum()])]


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, *, width: int = 16, steps: int = 2500, rate: float = 0.01, seed: int = 5) -> PUModel:
    """Non-negative PU risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    model = new_model(unl, prior, width, rng)
    adam = Adam([model.hidden, model.hidden_bias, model.out, model.out_bias], rate)
    for step in range(steps):
        adam.rate = rate * (1 - 0.9 * step / steps)
        p, u = pos[rng.integers(0, len(pos), 256)], unl[rng.integers(0, len(unl), 512)]
        s_p, s_u = sigmoid(model.logits(p)), sigmoid(model.logits(u))
        d_p, d_u = s_p * (1 - s_p), s_u * (1 - s_u)  # of the loss against the negative class, sigmoid(z)
        negative_risk = s_u.mean() - prior * s_p.mean()
        if negative_risk >= 0:
            slopes = (-prior * d_p - prior * d_p) / len(p), d_u / len(u)
        else:  # the negative risk is below zero: climb on it alone, R_u(-) - prior * R_p(-), and leave the positive risk
            slopes = prior * d_p / len(p), -d_u / len(u)
        grads = [a + b for a, b in zip(backward(model, p, slopes[0]), backward(model, u, slopes[1]), strict=True)]
        adam.step([g + 1e-4 * a for g, a in zip(grads, adam.arrays, strict=True)])
    return model


def fit_plain(pos: np.ndarray, unl: np.ndarray, *, steps: int = 1200, seed: int = 6) -> PUModel:
    """Positive against unlabelled, cross-entropy: ranks texts for the prior's estimate."""
    rng = np.random.default_rng(seed)
    model = new_model(unl, 0.5, 16, rng)
    adam = Adam([model.hidden, model.hidden_bias, model.out, model.out_bias], 0.01)
    for _ in range(steps):
        p, u = pos[rng.integers(0, len(pos), 256)], unl[rng.integers(0, len(unl), 256)]
        grads = [a + b for a, b in zip(backward(model, p, (sigmoid(model.logits(p)) - 1) / len(p)), backward(model, u, sigmoid(model.logits(u)) / len(u)), strict=True)]
        adam.step([g + 1e-3 * a for g, a in zip(grads, adam.arrays, strict=True)])
    return model


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Least ratio of shares above a score, each with a margin of one standard error."""
    half_p, half_u = len(pos) // 2, len(unl) // 2
    ranker = fit_plain(pos[:half_p], unl[:half_u])
    p, u = ranker.logits(pos[half_p:]), ranker.logits(unl[half_u:])
    best = 1.0
    for t in np.quantile(p, np.linspace(0.0, 0.9, 46)):
        a, b = (u >= t).mean(), (p >= t).mean()
        margin = (a * (1 - a) / len(u)) ** 0.5
        best = min(best, (a + margin) / max(b, 1e-9))
    return float(np.clip(best, 0.05, 0.97))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000) -> PUModel | None:
    """`docs` and `labels` must already be those one may learn from; of the labels only the positives are used."""
    known = one_label(labels, id_col, label_col)
    own = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    ids = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull())
    positives = lowest_hashes(known.where("_label = 1").select("_id"), "_id", sample_rows).withColumn("_kind", F.lit(1))
    unlabelled = lowest_hashes(ids, "_id", 2 * sample_rows, seed=43).distinct().withColumn("_kind", F.lit(0))
    picked = positives.unionByName(unlabelled).groupBy("_id").agg(F.sort_array(F.collect_set("_kind")).alias("_kinds"))
    rows = measured(rows_of(own, picked, id_col), "_text").select(F.xxhash64(id_col).alias("_place"), "_kinds", "statistics").collect()
    rows.sort(key=lambda r: (r["_place"], r["statistics"]))
    pos = np.array([r["statistics"] for r in rows if 1 in r["_kinds"]])
    unl = np.array([r["statistics"] for r in rows if 0 in r["_kinds"]])
    if len(pos) < 10 or len(unl) < 10:
        return None
    return fit_pu(pos, unl, estimate_prior(pos, unl))


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            x = statistics(batch.column(text_col))
            return {"statistics": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel(), pa.float64()))}

        return fn

    return append_columns(docs, [T.StructField("statistics", T.ArrayType(T.DoubleType()))], make, text_col)


def score(docs: DataFrame, model: PUModel | None, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1, higher: better). Narrow."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {out: pa.array(sigmoid(model.logits(statistics(batch.column(text_col)))), pa.float64())}

        return fn

    return append_columns(docs, [T.StructField(out, T.DoubleType())], make, text_col)
