"""Counterfactually regularised toxicity classifier.

A sparse logistic model over words and word beginnings, by presence and by rate in the text. For each
labelled sentence that names an identity term, counterfactual sentences swap the term for every other
term of its kind and for a neutral word; training penalises the squared change of the score, so identity terms end up with the weight of a
neutral word unless the rest of the sentence says otherwise, and neutral mentions of a group score low.

Learned from a bounded sample of labelled rows (``max_rows``), stems chosen over that sample;
every whole text is scored. Defined results: null and empty texts get the model's base score; with no
label of either class to learn from every score is 0.5; repeated rows are each scored; rows without an
id are scored and never learned from; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import labelled_sample, materialize

#: Terms that stand for one another in a counterfactual sentence, by kind.
IDENTITY_TERMS = {
    "gender": ("woman", "women", "man", "men", "female", "male", "transgender", "nonbinary"),
    "religion": ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist"),
    "origin": ("black", "white", "asian", "african", "latino", "arab", "immigrant", "immigrants", "refugee", "refugees"),
    "orientation": ("gay", "lesbian", "bisexual", "heterosexual", "homosexual", "queer", "straight"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "age": ("elderly", "old", "young", "teenage"),
}
_KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Lengths of the word beginnings that are stems beside whole words, which end in "$".
_BEGINNINGS = range(3, 9)
#: A stem gives one feature for each of these that holds of its count and the text's words.
_LEVELS = ("present", "twice", "one in 300", "one in 100")


def words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def stems(text: str | None) -> list[str]:
    """The distinct whole words and word beginnings of a text, sorted."""
    found = set()
    for w in words(text):
        found.add(f"{w}$")
        found.update(w[:k] for k in _BEGINNINGS if k < len(w))
    return sorted(found)


def active(text: str | None, place: dict[str, int]) -> list[int]:
    """Features that a text has, len(_LEVELS) for each stem of ``place``, ascending."""
    return features(words(text), place)


def features(counted: Counter[str], place: dict[str, int]) -> list[int]:
    """Features of a text by its words."""
    count: dict[int, int] = {}
    total = 0
    for w, n in counted.items():
        total += n
        if (i := place.get(f"{w}$")) is not None:
            count[i] = count.get(i, 0) + n
        for k in _BEGINNINGS:
            if k >= len(w):
                break
            if (i := place.get(w[:k])) is not None:
                count[i] = count.get(i, 0) + n
    return [len(_LEVELS) * i + k for i, n in sorted(count.items()) for k, on in enumerate((True, n >= 2, n * 300 >= total, n * 100 >= total)) if on]


def identity_mentions(text: str | None) -> list[str]:
    """Each identity term of each sentence, in order."""
    if not text or _KIND.keys().isdisjoint(words(text)):
        return []
    return [t for s in _SENTENCE.split(text) for t in sorted(_KIND.keys() & words(s).keys())]


#: Stands for the neutral word: it counts as a word and has no stems.
_NEUTRAL = ""


def swaps(text: str | None, place: dict[str, int]) -> Iterator[tuple[float, tuple[int, ...], tuple[int, ...]]]:
    """(weight, features gained, features lost) of each counterfactual sentence, alone and within its text;
    the weights of the swaps of one mention add up to 1 for either."""
    whole = words(text)
    if not text or _KIND.keys().isdisjoint(whole):
        return
    inside = set(features(whole, place))
    for sentence in _SENTENCE.split(text):
        own = words(sentence)
        found = _KIND.keys() & own.keys()
        alone = set(features(own, place)) if found else set()
        for t in sorted(found):
            others = [u for u in (*IDENTITY_TERMS[_KIND[t]], _NEUTRAL) if u != t]
            for u in others:
                for base, before in ((own, alone), (whole, inside)):
                    changed = base.copy()
                    changed[t] -= own[t]
                    if not changed[t]:
                        del changed[t]
                    changed[u] += own[t]
                    after = set(features(changed, place))
                    if after != before:
                        yield 1 / len(others), tuple(sorted(after - before)), tuple(sorted(before - after))


@dataclass
class StemModel:
    """Stems and the weights of their features; bounded by ``max_stems``."""

    base: float
    place: dict[str, int]
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.base + float(self.weights[active(text, self.place)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -40), 40))))


def train(
    vocabulary: list[str], rows: list[list[int]], y: np.ndarray, mentions: dict[str, int],
    sparse: float = 0.0003, ridge: float = 1e-4, counterfactual: float = 1.0, steps: int = 400,
    swapped: dict[tuple[tuple[int, ...], tuple[int, ...]], float] | None = None,
) -> StemModel:
    """Minimise mean log loss + sparse*|w| + ridge*|w|^2/2 + counterfactual * mean squared score change
    over the counterfactual sentences, by accelerated proximal gradient steps. rows: active features.
    swapped: weight by features gained and lost in a swap; mentions tie the terms' whole words alone."""
    n, k = len(rows), len(vocabulary) * len(_LEVELS)
    if n == 0 or y.min() == y.max():
        return StemModel(0.0, {}, np.zeros(0))
    x = np.zeros((n, k), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    place = {w: i for i, w in enumerate(vocabulary)}
    # swapping t for u in a sentence changes its logit by w[u] - w[t] at each level; for the neutral word by -w[t]
    penalty = np.zeros((k, k), np.float32)
    for term, count in mentions.items():
        others = [u for u in IDENTITY_TERMS[_KIND[term]] if u != term]
        share = counterfactual * count / (n * (len(others) + 1))
        for level in range(len(_LEVELS)):
            t = place[f"{term}$"] * len(_LEVELS) + level
            penalty[t, t] += share * (len(others) + 1)
            for u in (place[f"{u}$"] * len(_LEVELS) + level for u in others):
                penalty[u, u] += share
                penalty[t, u] -= share
                penalty[u, t] -= share
    pairs = sorted((swapped or {}).items())
    for at in range(0, len(pairs), 4096):
        part = pairs[at : at + 4096]
        change = np.zeros((len(part), k), np.float32)
        for i, ((gained, lost), _) in enumerate(part):
            change[i, list(gained)] = 1
            change[i, list(lost)] = -1
        weight = np.array([c for _, c in part], np.float32) * np.float32(counterfactual / n)
        penalty += change.T @ (change * weight[:, None])
    probe, size = np.ones(k, np.float32), 0.0
    for _ in range(20):
        probe = x.T @ (x @ probe) / n
        size = float(np.linalg.norm(probe))
        probe /= max(size, 1e-12)
    step = 1 / (0.25 * (size + 1) + ridge + 2 * float(np.abs(penalty).sum(1).max()) + 1e-9)
    w = w0 = np.zeros(k)
    b = b0 = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t1
        vw, vb = w + m * (w - w0), b + m * (b - b0)
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + vb, -40, 40)))
        g = p - y
        w0, b0, t = w, b, t1
        nw = vw - step * ((x.T @ g.astype(np.float32)) / n + ridge * vw + 2 * (penalty @ vw.astype(np.float32)))
        w = np.sign(nw) * np.maximum(np.abs(nw) - step * sparse, 0)
        b = vb - step * g.mean()
    used = sorted({i // len(_LEVELS) for i in np.flatnonzero(np.abs(w) > 1e-6).tolist()})
    kept = np.concatenate([w[i * len(_LEVELS) : (i + 1) * len(_LEVELS)] for i in used]) if used else np.zeros(0)
    return StemModel(b, {vocabulary[i]: j for j, i in enumerate(used)}, kept)


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, max_rows: int = 10000, max_stems: int = 320, least_docs: int = 8
) -> StemModel:
    """Learn from ``labels.toxic`` of rows whose remainder is not ``held``. Candidate stems are the
    ``max_stems`` of the sample whose document counts differ most from the base rate."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, bool], list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [[k for k, _ in count], [t for _, t in count], [v[0] for v in count.values()], [v[1] for v in count.values()]]
            count.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["stem", "term", "n", "hits"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for key in [*((x, False) for x in stems(text)), *((x, True) for x in identity_mentions(text))]:
                    seen = count.setdefault(key, [0, 0])
                    seen[0] += 1
                    seen[1] += y
                if len(count) > 200_000:
                    yield flush()
        yield flush()

    # exact copies of a text teach once, as toxic if any is labelled so
    sample = materialize(labelled_sample(docs, labels, "toxic", modulus, held, max_rows).groupBy("text").agg(F.max("y").alias("y")).select("y", "text"), "sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return StemModel(0.0, {}, np.zeros(0))
    counted = sample.mapInArrow(read, "stem string, term boolean, n long, hits long").groupBy("stem", "term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    counted = materialize(counted.where(F.col("term") | (F.col("n") >= least_docs)), "stems")
    rate = positive / n
    odd = F.abs(F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    ranked = counted.where("not term").orderBy(odd.desc(), "stem").limit(max_stems).collect()
    vocabulary = sorted({r.stem for r in ranked} | {f"{t}$" for t in _KIND})
    place = {w: i for i, w in enumerate(vocabulary)}

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([active(x, place) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), found], ["y", "at"])

    def swap_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64())
        total: dict[tuple[tuple[int, ...], tuple[int, ...]], float] = {}

        def flush() -> pa.RecordBatch:
            columns = [[g for g, _ in total], [x for _, x in total], list(total.values())]
            total.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["gained", "lost", "share"])

        for batch in batches:
            for text in batch.column(1):
                for c, gained, lost in swaps(text.as_py(), place):
                    total[gained, lost] = total.get((gained, lost), 0.0) + c
                if len(total) > 50_000:
                    yield flush()
        yield flush()

    changes = sample.mapInArrow(swap_all, "gained array<int>, lost array<int>, share double")
    changes = changes.groupBy("gained", "lost").agg(F.round(F.sum("share"), 6).alias("share"))
    swapped = {(tuple(r.gained), tuple(r.lost)): r.share for r in changes.collect()}
    got = sample.mapInArrow(place_all, "y int, at array<int>").toArrow()
    rows = sorted(zip(got["y"].to_pylist(), got["at"].to_pylist()))
    return train(vocabulary, [r for _, r in rows], np.array([y for y, _ in rows], np.float64), {}, swapped=swapped)


def score(docs: DataFrame, model: StemModel) -> DataFrame:
    """(doc_id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.record_batch([batch.column(0), found], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
