"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature's shape is a lookup table learned by cyclic boosting of trees with at most three leaves;
the strongest interactions are tables over two features, boosted the same way with four-leaf trees.
A score is a sum of table entries, so scoring is vectorised bin additions.

Learned from a bounded sample of labelled rows (``max_rows``), scored over every whole text.
Defined results: null and empty texts have all-zero features and a score; rows that repeat are each
scored; rows without an id are scored and never learned from; with no label of either class to learn
from, every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.common import labelled_sample, utf8

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stop_share", "line_words",
    "distinct_share", "distinct_pair_share", "top_word_share", "echo_share", "repeated_line_share", "wide_share",
)

_STOPS = np.frombuffer(b".,;:'\"-?()", np.uint8)
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def features(text: bytes) -> list[float]:
    """The values named in FEATURES for a whole UTF-8 text."""
    if not text:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    wide = int(hist[0xC0:].sum())
    digits, stops, spaces = int(hist[48:58].sum()), int(hist[_STOPS].sum()), int(hist[_SPACES].sum())
    chars = len(text) - int(hist[0x80:0xC0].sum())
    symbols = int(hist[:128].sum()) - upper - lower - digits - stops - spaces
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = Counter(words).most_common(1)
    pairs = max(len(words) - 1, 1)
    return [
        float(np.log1p(len(words))),
        (chars - spaces) / n,
        upper / max(upper + lower, 1),
        digits / max(chars, 1),
        symbols / max(chars, 1),
        stops / max(chars, 1),
        float(np.log1p(len(words) / max(len(lines), 1))),
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / pairs,
        (top[0][1] if top else 0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / pairs,
        1 - len(set(lines)) / max(len(lines), 1),
        wide / max(chars, 1),
    ]


def feature_matrix(column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    raw = data.tobytes()
    found = [features(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.array(found, np.float64).reshape(-1, len(FEATURES))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and position of the best cut of histogram bins; position k keeps bins below k on the left."""
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((lh >= least) & (rh >= least), gain, -np.inf)
    if not len(gain):
        return -np.inf, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shape_step(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values per bin of a tree with at most three leaves."""
    cuts = [0, len(g)]
    gain, k = _best_cut(g, h, ridge, least)
    if gain > 0:
        cuts = [0, k, len(g)]
        sides = [(_best_cut(g[a:b], h[a:b], ridge, least), a) for a, b in ((0, k), (k, len(g)))]
        (gain, k2), a = max(sides)
        if gain > 0:
            cuts = sorted({*cuts, a + k2})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _quadrants(x: np.ndarray) -> np.ndarray:
    """Sums of the four quadrants of a square histogram at every inner cut: shape (4, b-1, b-1)."""
    c = x.cumsum(0).cumsum(1)
    ll = c[:-1, :-1]
    lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
    return np.stack([ll, lr, rl, c[-1, -1] - ll - lr - rl])


def _pair_step(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best four-leaf tree with one cut on each of two features."""
    qg, qh = _quadrants(g), _quadrants(h)
    gain = np.where((qh >= least).all(0), (qg**2 / (qh + ridge)).sum(0) - g.sum() ** 2 / (h.sum() + ridge), -np.inf)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    if gain[i, j] > 0:
        v = _leaf(qg[:, i, j], qh[:, i, j], ridge)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; a few kilobytes whatever the corpus."""

    base: float
    cuts: list[np.ndarray]
    shapes: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cut, shape) in enumerate(zip(self.cuts, self.shapes)):
            total += shape[np.searchsorted(cut, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], "right") for i, j, _ in self.pairs for k in (i, j)}
        for i, j, values in self.pairs:
            total += values[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def train(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, rate: float = 0.1,
    pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 100, ridge: float = 1.0, least: float = 2.0,
) -> AdditiveModel:
    """Fit the tables. ``least`` is the smallest sum of p(1-p) in a leaf."""
    k = x.shape[1] if x.ndim == 2 else 0
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(0.0, [np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, [])

    def cut_points(n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(k)]

    cuts, coarse_cuts = cut_points(bins), cut_points(pair_bins)
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    shapes = [np.zeros(len(c) + 1) for c in cuts]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            n = len(shapes[f])
            step = rate * _shape_step(np.bincount(binned[f], g, n), np.bincount(binned[f], h, n), ridge, least)
            shapes[f] += step
            total += step[binned[f]]

    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse_cuts)]

    def pair_hist(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * pair_bins + coarse[j], v, pair_bins**2).reshape(pair_bins, pair_bins)

    g, h = slopes()
    ranked = sorted(
        ((_pair_step(pair_hist(i, j, g), pair_hist(i, j, h), ridge, least)[0], i, j) for i in range(k) for j in range(i + 1, k)),
        reverse=True,
    )
    found = [(i, j, np.zeros((pair_bins, pair_bins))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, values in found:
            g, h = slopes()
            step = rate * _pair_step(pair_hist(i, j, g), pair_hist(i, j, h), ridge, least)[1]
            values += step
            total += step[coarse[i], coarse[j]]
    return AdditiveModel(base, cuts, shapes, coarse_cuts, found)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_rows: int = 20000) -> AdditiveModel:
    """Learn from ``labels.quality`` of rows whose remainder is not ``held``; at most ``max_rows`` of
    them reach the driver, as feature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1))
            yield pa.record_batch([batch.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["y", *FEATURES])

    sample = labelled_sample(docs, labels, "quality", modulus, held, max_rows).select("y", "text")
    got = sample.mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.column_stack([got[f].to_numpy() for f in FEATURES]) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, got["y"].to_numpy()]) if len(got) else np.zeros(0, np.int64)
    return train(x[order], got["y"].to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.score(feature_matrix(batch.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_matrix(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
