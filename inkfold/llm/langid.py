"""Language identification by prediction by partial matching with frozen statistics.

One context tree over folded bytes is shared by all languages and holds each language's counts. The
probability of a byte after a context is its share there, or the escape probability times its
probability after the next shorter context, down to a uniform order. Since the statistics are frozen,
each (context, byte) code length is computed once; the tree becomes an automaton whose longest matching
context is found by ``order`` table lookups for all bytes of a block at once, and a text's exact code
length per language is a sum of table entries. The shortest code wins.

Folding: ASCII and Latin-1 capitals become small letters; runs of ASCII non-letters become one blank.
Learned from a bounded sample per language (``per_lang``, rounded up to a whole number per bucket) of the
``max_langs`` languages with the most rows; the tree holds the ``max_nodes`` most used contexts, fewer with more than
16 languages, so the model is bounded whatever the column lang holds. Every whole text is scored; a text above a
mebibyte is scored alone, in memory of some forty bytes for each of its own.
Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn
from every text is ``und``; repeated rows are each returned; ties go to the language that sorts first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import blocks, remainder, utf8

#: blank, 26 letters, 128 bytes of multi-byte characters
SYMBOLS = 155
BUCKETS = 32
#: Entries of the dense code-length table, 4 bytes each; the tree gets fewer nodes for more languages.
MAX_CELLS = 12_000 * SYMBOLS * 16
_FOLD = np.zeros(256, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, 155)


def symbols(data: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of concatenated texts, each preceded by ``pad`` blanks, and the offsets of the
    padded texts. A text's own leading blanks are dropped, so the padding is the one start context."""
    found = _FOLD[data]
    if len(data):
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        found[capital] += 0x20
    blank = found == 0
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    keep = ~(blank & (before | first[:-1]))
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    sizes = np.diff(kept)
    out = np.zeros(len(sizes) * pad + int(kept[-1]), np.uint8)
    out[np.arange(int(kept[-1])) + pad * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = found[keep]
    return out, kept + pad * np.arange(len(kept))


def _inner(at: np.ndarray, pad: int) -> np.ndarray:
    """Mask of positions that are not padding."""
    inner = np.ones(int(at[-1]), bool)
    for k in range(pad):
        inner[at[:-1] + k] = False
    return inner


def count_grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``order`` context symbols and the next one, packed base SYMBOLS, with counts."""
    text, offsets = symbols(data, at, order)
    if len(text) <= order:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = text.astype(np.int64)
    key = np.zeros(len(text) - order, np.int64)
    for k in range(order + 1):
        key = key * SYMBOLS + wide[k : len(text) - order + k]
    return np.unique(key[_inner(offsets, order)[order:]], return_counts=True)


@dataclass
class ContextModel:
    """langs; go[node, symbol] -> node of the longest known suffix; bits[node, symbol, lang]."""

    langs: list[str]
    order: int
    go: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and symbols coded."""
        text, offsets = symbols(data, at, self.order)
        n = len(at) - 1
        total = np.zeros((n, len(self.langs)))
        coded = np.diff(offsets) - self.order
        if not len(text):
            return total, coded
        state = np.zeros(len(text), np.int32)
        wide = text.astype(np.int32)
        flat = self.go.reshape(-1)
        for _ in range(self.order):
            before = np.empty_like(state)
            before[0] = 0
            before[1:] = state[:-1]
            before *= SYMBOLS
            before += wide
            state = flat[before]
        slot = np.empty_like(state)
        slot[0] = 0
        slot[1:] = state[:-1]
        slot = (slot * SYMBOLS + wide)[_inner(offsets, self.order)]
        rows = self.bits.reshape(-1, len(self.langs))[slot]
        full = coded > 0
        starts = (np.cumsum(coded) - coded)[full]
        if len(starts):
            total[full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        return total, coded


def build(langs: list[str], lang: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int, max_nodes: int) -> ContextModel:
    """The frozen model from gram counts: row i says that language index lang[i] saw keys[i] counts[i] times."""
    size = len(langs)
    context, symbol = keys // SYMBOLS, keys % SYMBOLS
    seen: dict[tuple[int, int], int] = {(0, 0): 1 << 62}
    for k in range(1, order + 1):
        part, inverse = np.unique(context % SYMBOLS**k, return_inverse=True)
        seen |= {(k, int(c)): int(n) for c, n in zip(part, np.bincount(inverse, counts, len(part)))}
    # the most used contexts, shorter first among equals, with all their prefixes and suffixes
    chosen = {(0, 0)}
    for k, c in sorted(seen, key=lambda x: (-seen[x], x)):
        if len(chosen) >= max_nodes:
            break
        for a in range(k):
            for b in range(a + 1, k + 1):
                chosen.add((b - a, c // SYMBOLS ** (k - b) % SYMBOLS ** (b - a)))
    nodes = sorted(chosen)
    place = {x: i for i, x in enumerate(nodes)}
    go = np.zeros((len(nodes), SYMBOLS), np.int32)
    suffix = np.zeros(len(nodes), np.int32)
    for i, (k, c) in enumerate(nodes):
        suffix[i] = place[(k - 1, c % SYMBOLS ** (k - 1))] if k else 0
        if i:
            go[i] = go[suffix[i]]
        else:
            go[0] = 0
        for s in range(SYMBOLS):
            longer = (k + 1, c * SYMBOLS + s)
            if longer in place:
                go[i, s] = place[longer]
    chance = np.full((len(nodes), SYMBOLS, size), 1 / SYMBOLS)
    depth = np.array([k for k, _ in nodes])
    for k in range(order + 1):
        where = np.flatnonzero(depth == k)
        if not len(where):
            continue
        if k:
            chance[where] = chance[suffix[where]]
        code = np.array([nodes[i][1] for i in where])
        mine = context % SYMBOLS**k
        slot = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        ok = code[slot] == mine
        table = np.zeros((len(where), SYMBOLS, size))
        np.add.at(table, (slot[ok], symbol[ok], lang[ok]), counts[ok])
        total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        chance[where] = np.where(table > 0, table / np.maximum(total + kinds, 1), escape * chance[where])
    return ContextModel(langs, order, go, -np.log2(chance).astype(np.float32))


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = 600, order: int = 4, max_nodes: int = 12000, max_langs: int = 200) -> ContextModel:
    """Learn from text and non-null lang of rows whose remainder is not ``held``: of each language at
    most ``per_lang`` rows, whole, chosen by a hash of doc_id. The hash deals a language's rows to
    BUCKETS, each of which gives its share, so no task ranks a whole language. Only gram counts reach
    the driver."""
    rank = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (
        docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
        .distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
        .withColumn("rank", rank).where(F.col("rank") <= -(-per_lang // BUCKETS)).select("doc_id", "lang")
    )
    most = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != held)).groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r.lang for r in most.orderBy(F.desc("n"), "lang").limit(max_langs).collect())
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for k in np.unique(kind):
                keys, counts = count_grams(*utf8(batch.column(1).filter(pa.array(kind == k))), order)
                yield pa.record_batch([pa.array(np.full(len(keys), k)), pa.array(keys), pa.array(counts)], ["lang", "key", "n"])

    chosen = chosen.where(F.col("lang").isin(langs)) if len(langs) == max_langs else chosen
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    got = sample.mapInArrow(run, "lang long, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, keys, counts = (got[c].to_numpy() for c in ("lang", "key", "n"))
    return build(langs, lang, keys, counts, order, min(max_nodes, MAX_CELLS // (SYMBOLS * max(len(langs), 1))))


def predict(docs: DataFrame, model: ContextModel) -> DataFrame:
    """(doc_id, lang_pred, score) per row; score is the posterior of the prediction, equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            data, at = utf8(batch.column(1))
            lettered = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False) & bool(m.langs)
            best = np.full(len(at) - 1, len(m.langs))
            sure = np.zeros(len(at) - 1)
            for i, j in blocks(at) if m.langs else ():
                bits, _ = m.code_lengths(data[at[i] : at[j]], at[i : j + 1] - at[i])
                best[i:j] = bits.argmin(1)
                sure[i:j] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -200)).sum(1)
            best[~lettered], sure[~lettered] = len(m.langs), 0
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
