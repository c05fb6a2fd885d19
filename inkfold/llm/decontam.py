"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Each benchmark item is cut into overlapping windows (a short item is one window). A text that holds a
window within k edits shares at least m + 1 - q(k + 1) of its q-grams with it, on diagonals at most k
apart; so shared q-grams are counted in overlapping diagonal bands, bands that reach the bound are kept
and verified by an alignment restricted to the band. Nothing within the edit budget is lost.

Texts and items are compared folded: ASCII and Latin-1 capitals as small letters, every run of other
ASCII characters than letters and digits as one blank. Positions are in the folded text.
Defined results: a null or empty text or item takes no part; items of fewer than q folded bytes take no
part; repeated rows are each searched; an empty benchmark, or no documents, give no rows; other columns are ignored.
A text above a mebibyte is searched alone, in memory of some tens of bytes for each of its own; what frequent q-grams
expand to is handled by ranges of windows, about ``EXPAND`` entries at a time unless a single window has more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import blocks, materialize, utf8

Q = 8
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
EXPAND = 1 << 22
#: alignment cells hold cost * _UNIT + start column, so the smallest cell also names its start
_UNIT = np.int64(1 << 32)


def fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of concatenated texts, and their offsets."""
    out = _FOLD[data]
    if not len(data):
        return out, at
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    blank = out == 32
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    keep = ~(blank & (before | first[:-1]))
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


@dataclass
class Windows:
    """The searched windows, and an inverted index from q-gram to (window, offset)."""

    item: np.ndarray
    item_windows: dict[int, int]
    length: np.ndarray
    budget: np.ndarray
    texts: np.ndarray
    bitmap: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each position, as the eight bytes it is."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))


def windows(items: list[tuple[int, str]], size: int, stride: int, error: float) -> Windows:
    found: list[tuple[int, np.ndarray]] = []
    for item, text in items:
        data, at = fold(*utf8(pa.array([text])))
        data = data[: len(data) - 1] if len(data) and data[-1] == 32 else data
        if len(data) < Q:
            continue
        starts = list(range(0, max(len(data) - size, 0) + 1, stride))
        if starts[-1] + size < len(data):
            starts.append(len(data) - size)
        found += [(item, data[s : s + size]) for s in starts]
    n = len(found)
    length = np.array([len(x) for _, x in found], np.int64)
    # the largest budget under which the lemma still demands a shared q-gram
    budget = np.minimum((length * error).astype(np.int64), (length - Q) // Q)
    texts = np.zeros((n, size), np.uint8)
    for k, (_, x) in enumerate(found):
        texts[k, : len(x)] = x
    gram = np.concatenate([grams(x) for _, x in found]) if n else np.zeros(0, np.uint64)
    window = np.repeat(np.arange(n), np.maximum(length - Q + 1, 0))
    offset = np.concatenate([np.arange(len(x) - Q + 1) for _, x in found]) if n else np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    keys, first = np.unique(gram[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[((keys * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    items_of = np.array([i for i, _ in found], np.int64)
    names, counts = np.unique(items_of, return_counts=True)
    return Windows(
        items_of, dict(zip(names.tolist(), counts.tolist())), length, budget, texts, bitmap, keys,
        np.append(first, len(order)), window[order], offset[order],
    )


def candidates(w: Windows, data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first diagonal) of each pair of neighbouring bands, ``width`` diagonals each, that
    reaches the bound of the q-gram lemma. data, at: folded texts."""
    none = (np.zeros(0, np.int64),) * 3
    gram = grams(data)
    if not len(gram) or not len(w.keys):
        return none
    pos = np.flatnonzero(w.bitmap[((gram * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)])
    got = gram[pos]
    slot = np.minimum(np.searchsorted(w.keys, got), len(w.keys) - 1)
    same = w.keys[slot] == got
    pos, slot = pos[same], slot[same]
    text = np.searchsorted(at, pos, "right") - 1
    inside = pos + Q <= at[text + 1]
    pos, slot, text = pos[inside], slot[inside], text[inside]
    many = w.first[slot + 1] - w.first[slot]
    if not many.sum():
        return none
    first, total = w.first[slot], int(many.sum())
    if total <= EXPAND:
        return _banded(w, at, width, pos, text, first, many)
    # ranges of windows with at most about EXPAND shared q-grams each; a q-gram's windows are listed in order
    uses = np.bincount(slot, minlength=len(w.keys))
    share = np.bincount(w.window, np.repeat(uses, np.diff(w.first)), len(w.length)).cumsum()
    cuts = np.unique([0, *(np.searchsorted(share, np.arange(EXPAND, total, EXPAND)) + 1).tolist(), len(w.length)])
    listed = np.repeat(np.arange(len(w.keys)), np.diff(w.first)) * len(w.length) + w.window
    found = []
    for low, high in zip(cuts, cuts[1:]):
        start, stop = (np.searchsorted(listed, slot * len(w.length) + x) for x in (low, high))
        some = stop > start
        if some.any():
            found.append(_banded(w, at, width, pos[some], text[some], start[some], (stop - start)[some]))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _banded(
    w: Windows, at: np.ndarray, width: int, pos: np.ndarray, text: np.ndarray, first: np.ndarray, many: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates among ``many`` entries of the index from ``first`` on, which share the q-grams at ``pos``."""
    shift = w.texts.shape[1]
    span = int((at[1:] - at[:-1]).max() + shift) // width + 3
    listed = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    text, pos = np.repeat(text, many), np.repeat(pos, many)
    band = (pos - at[text] - w.offset[listed] + shift) // width
    key, count = np.unique((text * len(w.length) + w.window[listed]) * span + band, return_counts=True)
    following = np.zeros_like(count)
    following[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    preceding = np.zeros_like(count)
    preceding[1:] = np.where(key[:-1] == key[1:] - 1, count[:-1], 0)
    pair, band = key // span, key % span
    window = pair % len(w.length)
    bound = w.length[window] + 1 - Q * (w.budget[window] + 1)
    # a band opens a pair with its follower; a band without predecessor also closes a pair of its own
    ok = count + following >= bound
    alone = (preceding == 0) & (count >= bound) & ~ok
    ok |= alone
    return pair[ok] // len(w.length), window[ok], (band[ok] * width) - shift


def align(w: Windows, data: np.ndarray, at: np.ndarray, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray, width: int):
    """(edits, start, end) of the best alignment of each candidate's window inside its band pair widened
    by the budget on each side; edits above the budget mean no match. All candidates step together."""
    n, k = len(text), int(w.budget[window].max())
    columns = 2 * width + 2 * k
    low = at[text] + diagonal - k
    d = np.arange(columns)
    cell = np.broadcast_to(low[:, None] + d, (n, columns)).astype(np.int64) - at[text][:, None]
    cell = np.maximum(cell, 0)
    begin, stop = at[text][:, None], at[text + 1][:, None]
    done = np.full(n, np.iinfo(np.int64).max)
    place = np.zeros(n, np.int64)
    ramp = d * _UNIT
    longest = int(w.length[window].max())
    for i in range(longest):
        spot = low[:, None] + d + i
        inside = (spot >= begin) & (spot < stop)
        letter = data[np.clip(spot, 0, len(data) - 1)]
        differs = ~(inside & (letter == w.texts[window, i][:, None]))
        step = cell + np.where(differs, _UNIT, 0)
        step[:, :-1] = np.minimum(step[:, :-1], cell[:, 1:] + _UNIT)
        # cost * _UNIT + start: an insertion moves one diagonal right and costs one edit
        cell = np.minimum.accumulate(step - ramp, axis=1) + ramp
        last = w.length[window] == i + 1
        if last.any():
            best = cell[last].argmin(1)
            done[last] = cell[last, best]
            place[last] = (low[last] - at[text][last]) + best + i + 1
    size = at[text + 1] - at[text]
    return done // _UNIT, np.minimum(done % _UNIT, size), np.clip(place, 0, size)


def search(w: Windows, data: np.ndarray, at: np.ndarray, limit: int = 512) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(text, item) -> (windows matched, least edits, start, end) over folded texts."""
    if not len(w.length):
        return {}
    width = max(int(w.budget.max()) + 1, 8)
    text, window, diagonal = candidates(w, data, at, width)
    best: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
    for s in range(0, len(text), limit):
        part = slice(s, s + limit)
        edits, start, end = align(w, data, at, text[part], window[part], diagonal[part], width)
        good = edits <= w.budget[window[part]]
        for t, v, *x in zip(*(a[good].tolist() for a in (text[part], window[part], edits, start, end))):
            kept = best.setdefault((t, int(w.item[v])), {})
            kept[v] = min(kept.get(v, tuple(x)), tuple(x))
    return {k: (len(v), *min(v.values())) for k, v in best.items()}


def _groups(bench: DataFrame, size: int, stride: int, error: float, max_bytes: int) -> Iterator[Windows]:
    """Window sets of the benchmark; a benchmark above ``max_bytes`` is searched in several passes, so
    the index each task holds stays bounded, but for a single item above that size."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = -(-total // max_bytes)
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        yield windows([(r.item_id, r.text) for r in part], size, stride, error)


def contaminated(
    docs: DataFrame, bench: DataFrame, size: int = 120, stride: int = 60, error: float = 0.1, max_bytes: int = 8 << 20
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, windows (matched),
    item_windows (all of the item), edits (of the best window), start and end (in the folded text)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, windows long, item_windows long, edits long, start long, end long"
    out, before = None, None
    for w in _groups(bench, size, stride, error, max_bytes):
        if before is not None:
            # of several passes one index at a time is held
            out = materialize(out, "contaminated")
            before.destroy()
        shared = before = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = utf8(batch.column(1))
                ids = batch.column(0).to_pylist()
                rows = []
                for i, j in blocks(at):
                    found = search(shared.value, *fold(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                    rows += [(ids[i + t], item, n, shared.value.item_windows[item], *x) for (t, item), (n, *x) in sorted(found.items())]
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "windows", "item_windows", "edits", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, size: int = 120, stride: int = 60, error: float = 0.1, max_bytes: int = 8 << 20
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    at_text = docs.columns.index("text")
    out, before = docs, None
    for w in _groups(bench, size, stride, error, max_bytes):
        if before is not None:
            out = materialize(out, "clean")
            before.destroy()
        shared = before = docs.sparkSession.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = utf8(batch.column(at_text))
                clean = np.ones(batch.num_rows, bool)
                for i, j in blocks(at):
                    for t, _ in search(shared.value, *fold(data[at[i] : at[j]], at[i : j + 1] - at[i])):
                        clean[i + t] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
