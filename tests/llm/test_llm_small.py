"""Null, empty, repeated, very long and clashing inputs, and results against brute force, on small tables."""

import zlib
from collections import Counter
from glob import glob

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfold.llm import ann, components, decontam, langid, linededup, mixing, quality, simhash, toxicity, urlrules, warc
from inkfold.llm.common import blocks, cleanup, fresh_path, utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# common


def test_utf8_and_blocks():
    data, at = utf8(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(data) == "é".encode() and at.tolist() == [0, 0, 2, 2]
    assert list(blocks(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(blocks(np.array([0]), 6)) == []


def test_cleanup_deletes_what_was_written(spark, tmp_path):
    path = fresh_path(spark, "probe")
    spark.range(3).write.parquet(path)
    cleanup(spark)
    assert not glob(f"{path.removeprefix('file:')}*")


def test_components_against_union_find(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (110, 2))] + [(500, 500)]
    edges += [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    for in_one in (0, 40, 1 << 21):
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), in_one=in_one).collect()}
        assert got == {x: find(x) for x in parent if find(x) != x}


# SimHash


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        base = [vocabulary[k] for k in rng.integers(0, 300, int(rng.integers(1, 400)))]
        rows.append((3 * i, " ".join(base), "a"))
        for c in range(int(rng.integers(0, 4))):
            edited = list(base)
            edited[int(rng.integers(0, len(base)))] = "changed"
            rows.append((1000 + 10 * i + c, " ".join(edited).upper() if c else " ".join(base), "a"))
    rows += [(5000, None, None), (5001, "", "b"), (5002, " \n\t ", "b"), (7, "dup row", "a"), (7, "dup row", "a"), (None, "no id", "a"), (9, "a b c", "a"), (10, "A\x0bB\x1fC", "a"), (11, "long " * 200_000, "a")]
    got = simhash.near_duplicates(docs_of(spark, rows), radius=4, shingle=4, tile_rows=16).collect()
    assert len(got) == len(rows)
    fps = [(i, brute_fingerprint(t, 4)) for i, t, _ in rows]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), c in zip(fps, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{f:016x}", least.get(c)) for (i, f), c in zip(fps, label))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_group_within_one_tile_is_a_forest():
    a = np.arange(3000, dtype=np.uint64) % np.uint64(16)
    i, j = simhash.close_pairs(a, a, 4)
    assert len(i) <= len(a) * 2 - 1


def test_drop_near_duplicates_keeps_columns_and_smallest(spark):
    docs = docs_of(spark, [(5, "x y z q r", "a"), (3, "x y z q r", "b"), (8, "other words here now then", "c"), (None, "x y z q r", "d")]).withColumn("component_id", F.lit("clash"))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 3, 8]


# quality


def test_quality_learns_and_handles_odd_rows(spark):
    good, bad = "The words of this text are calm and plain, and they go on for a while.\n", "BUY!! NOW!! BUY!! NOW!! $$$ ### BUY!!\n"
    rows = [(k, good * (1 + k % 5) + f"tail {k}" if k % 3 else bad * (1 + k % 4), "s") for k in range(300)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x" * 1_000_000, "s"), (None, good, "s"), (1, good, "s")]
    docs = docs_of(spark, rows).withColumn("score", F.lit("clash")).withColumn("y", F.lit(0))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 300 and doc_id % 3 > 0").count() >= 195


def test_quality_interactions_find_an_exclusive_or():
    x = np.random.default_rng(0).random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.train(x, y), quality.train(x, y, pairs=0)
    assert np.mean((with_pairs.score(x) > 0.5) == y) > 0.9 > np.mean((without.score(x) > 0.5) == y)


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, [(1, "some text", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, none)).first().score == 0.5
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().score == 0.5
    empty = docs.where("false")
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


# toxicity


def test_toxicity_learns_and_identity_terms_stay_neutral(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for k in range(600):
        text = " ".join(words[j] for j in rng.integers(0, 80, 40))
        toxic = k % 6 == 0
        if toxic:
            text += " you vile person. A muslim walked by." if k % 12 == 0 else " so vile."
        elif k % 50 == 1:
            text += " A muslim walked by."
        rows.append((k, text, "s"))
        labels.append((k, 1, int(toxic)))
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, "A muslim walked by.", "s"), (9003, "A christian walked by.", "s"), (None, "vile", "s"), (9004, "calm " * 100_000 + "vile", "s")]
    docs = docs_of(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.3) == (k % 6 == 0) for k in held]) > 0.97
    assert got[9002] < 0.3 and got[9000] == got[9001]
    free = toxicity.train(["muslim$", "vile$", *sorted({f"{t}$" for t in toxicity._KIND} - {"muslim$"})], *_tiny_rows(), {}, sparse=0.0)
    tied = toxicity.train(["muslim$", "vile$", *sorted({f"{t}$" for t in toxicity._KIND} - {"muslim$"})], *_tiny_rows(), {"muslim": 2000}, sparse=0.0)
    text = "a muslim walked"
    assert tied.score(text) < free.score(text)


def test_swapped_sentences_change_the_beginnings_too():
    vocabulary = sorted({"mus", "musl", "vile$"} | {f"{t}$" for t in toxicity._KIND})
    place = {w: i for i, w in enumerate(vocabulary)}
    texts = ["A muslim walked. Vile.", "A muslim sat."] * 20 + ["Vile talk.", "A calm day.", "More calm.", "All calm."] * 20
    rows = [toxicity.active(x, place) for x in texts]
    y = np.array([1, 1] * 20 + [1, 0, 0, 0] * 20, float)
    swapped = Counter()
    for x in texts:
        for c, gained, lost in toxicity.swaps(x, place):
            swapped[gained, lost] += c
    assert any(len(_levels_of(lost, place["mus"])) and len(_levels_of(lost, place["muslim$"])) for _, lost in swapped)
    whole = toxicity.train(vocabulary, rows, y, {"muslim": 40}, counterfactual=20.0)
    real = toxicity.train(vocabulary, rows, y, {}, counterfactual=20.0, swapped=dict(swapped))
    change = [abs(m.score("A muslim ran.") - m.score("A christian ran.")) for m in (whole, real)]
    assert change[1] < 0.1 < change[0]


def _levels_of(lost, stem):
    return [x for x in lost if x // len(toxicity._LEVELS) == stem]


def _tiny_rows():
    rows = [[0, 4], [0, 4], [0], [4], [], [], [], []] * 10
    return rows, np.array([1, 1, 1, 1, 0, 0, 0, 0] * 10, float)


# language identification


def brute_bits(model, text):
    """Walk the automaton one symbol at a time."""
    folded, at = langid.symbols(*utf8(pa.array([text])), 0)
    state, total = 0, np.zeros(len(model.langs))
    for _ in range(model.order):
        state = model.go[state, 0]
    for s in folded.tolist():
        total += model.bits[state, s].astype(np.float64)
        state = model.go[state, s]
    return total


def test_langid(spark):
    samples = {"en": "the house of the king and the queen was thought to be there", "de": "das haus des königs und der königin war schön und groß gewesen", "fr": "la maison du roi et de la reine était très belle à côté"}
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        words = samples[lang].split()
        rows.append((k, " ".join(words[j] for j in rng.integers(0, len(words), 30)), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !! …", "en", "s", 0), (903, "THE HOUSE OF THE KING", None, "s", 0), (904, "KÖNIGIN SCHÖN GROSS", None, "s", 0), (None, "la reine", "fr", "s", 0), (905, "the king " * 100_000, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[k][0] == ("en", "de", "fr")[k % 3] for k in range(240))
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert (got[903][0], got[904][0], got[None][0], got[905][0]) == ("en", "de", "fr", "en")
    assert all(0 <= s <= 1 for _, s in got.values())
    texts = [r[1] for r in rows[:20]] + ["Éa Ó  x", "zq"]
    bits, _ = model.code_lengths(*utf8(pa.array(texts)))
    assert np.allclose(bits, [brute_bits(model, t) for t in texts], rtol=1e-6)
    # the chances of all symbols after a context sum to no more than one
    assert (np.exp2(-model.bits.astype(float)).sum(1) <= 1 + 1e-4).all()
    two = langid.fit(docs, max_langs=2)
    assert len(two.langs) == 2
    many = spark.createDataFrame([(k, f"word{k} text", f"l{k}", "s", 0) for k in range(300)], DOCS)
    wide = langid.fit(many)
    assert len(wide.langs) == 200 and wide.bits.size <= langid.MAX_CELLS * 1.2
    empty = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


# line dedup


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    shared = [f"this boilerplate line number {k} is shared by sites" for k in range(12)]
    rows = []
    for i in range(120):
        lines = [f"own line {i} {j} of the document with text" for j in range(3)] + [shared[k] for k in rng.integers(0, 12, 2)] + ["short"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{rng.integers(0, 6)}" if i % 10 else None))
    rows += [(500, None, "site1"), (501, "", "site1"), (7, rows[7][1], rows[7][2]), (None, "  " + shared[0] + "\t\r\n" + shared[0], "x"), (502, "\n\n", "y"), (503, "long line " * 50_000, "z")]
    docs = docs_of(spark, rows).withColumn("pos", F.lit("clash")).withColumn("h", F.lit(1))
    for name in ("__cut", "__id", "__text_key", "word", "mask", "hit", "id", "key", "gone"):
        docs = docs.withColumn(name, F.lit("clash"))
    for min_sites in (3, 5):
        got = linededup.dedup_lines(docs, min_sites=min_sites, min_chars=20, lg_k=8)
        assert got.columns == docs.columns
        sites, where = {}, {}
        for i, t, s in rows:
            for p, line in enumerate((t if t is not None else "").split("\n")):
                key = line.strip(" \t\r")
                if len(key) >= 20:
                    sites.setdefault(key, set()).add(s or "")
                    where.setdefault(key, set()).add((-1 if i is None else i, p))
        want = Counter()
        for i, t, s in rows:
            kept = [line for p, line in enumerate((t or "").split("\n")) if len(sites.get(line.strip(" \t\r"), ())) < min_sites or (-1 if i is None else i, p) == min(where[line.strip(" \t\r")])]
            want[(i, None if t is None else "\n".join(kept))] += 1
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert linededup.dedup_lines(docs.where("false")).count() == 0


# decontamination


def edit_distance_in(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        step = np.minimum(row[:-1] + np.array([c != d for d in text]), row[1:] + 1)
        for j in range(len(text)):
            new[j + 1] = min(step[j], new[j] + 1)
        row = new
    return int(row.min())


def test_frequent_grams_are_expanded_by_groups(monkeypatch):
    items = [(k, f"the same opening words of every item then number {k} " + "and on " * 12) for k in range(30)]
    w = decontam.windows(items, 80, 40, 0.1)
    data, at = decontam.fold(*utf8(pa.array([t for _, t in items] + ["and on " * 60])))
    whole = decontam.search(w, data, at)
    monkeypatch.setattr(decontam, "EXPAND", 3000)
    assert whole and decontam.search(w, data, at) == whole


def test_decontamination_against_full_alignment(spark):
    rng = np.random.default_rng(6)
    alphabet = list("abcdefgh ")
    make = lambda n: "".join(alphabet[k] for k in rng.integers(0, 9, n)).strip()
    items = [(k, make(int(rng.integers(60, 200)))) for k in range(8)] + [(90, None), (91, ""), (92, "tiny")]

    def damaged(text, edits):
        for _ in range(edits):
            k = int(rng.integers(0, len(text)))
            text = text[:k] + text[k + 1 :] if rng.random() < 0.4 else text[:k] + "z" + text[k + int(rng.random() < 0.5) :]
        return text

    rows = [(i, make(400) + " " + (damaged(items[i % 8][1], int(rng.integers(0, 26))) if i % 2 else "") + " " + make(300), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, items[0][1].upper().replace(" ", " ... "), "s"), (102, items[0][1], "s"), (103, make(30_000) + items[1][1], "s"), (None, items[2][1], "s")]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    size, stride, error = 80, 40, 0.1
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, size, stride, error).collect()}
    w = decontam.windows([x for x in items if x[1]], size, stride, error)
    for i, text, _ in rows:
        if i == 103:
            continue
        folded = bytes(decontam.fold(*utf8(pa.array([text])))[0])
        for item in {k for k, t in items if t}:
            mine = [(edit_distance_in(bytes(w.texts[k][: w.length[k]]), folded), w.budget[k]) for k in range(len(w.item)) if w.item[k] == item]
            matched = [e for e, b in mine if e <= b]
            assert ((i, item) in got) == bool(matched), (i, item, mine)
            if matched:
                assert got[i, item].edits == min(matched)
    assert (103, 1) in got
    kept = decontam.drop_contaminated(docs, bench, size, stride, error)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted((i if i is not None else -1) for i, _, _ in rows if not any(k[0] == i for k in got))
    in_passes = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, size, stride, error, max_bytes=300).collect()}
    assert in_passes == set(got)
    assert decontam.contaminated(docs, bench.where("false")).count() == 0


# mixing


def test_period_schedule_stays_within_a_block():
    rng = np.random.default_rng(8)
    for _ in range(20):
        weights = {f"s{k}": float(w) for k, w in enumerate(rng.random(int(rng.integers(1, 40))) ** 3 + 1e-4)}
        share = mixing.quotas(weights, 256)
        assert sum(share.values()) == 256 and min(share.values()) >= 1
        done = Counter()
        for t, (s, i, slot) in enumerate(mixing.period_schedule(share)):
            assert slot == t and i == done[s]
            done[s] += 1
            assert all(abs(done[x] - (t + 1) * a / 256) < 1 for x, a in share.items())


def test_mix_keeps_all_rows_and_the_bound(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(1, "again", "hot"), (None, "n", None), (9999, None, "")]
    rows += [(None, f"no id {k}", "hot") for k in range(500)]
    docs = docs_of(spark, rows).withColumn("slot", F.lit("clash")).withColumn("i", F.lit(0)).withColumn("mix_slot", F.lit(-1))
    for name in ("__rank", "__key", "__bucket", "__all", "__i", "__slot"):
        docs = docs.withColumn(name, F.lit("kept"))
    got = mixing.mix(docs, block_docs=8, period=64).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert all(r["__rank"] == r["__key"] == r["__bucket"] == r["__all"] == r["__i"] == r["__slot"] == "kept" for r in got)
    seats = Counter((r.mix_slot, r.mix_place) for r in got)
    assert max(seats.values()) == 1
    weights = mixing.square_root_weights(Counter(s or "" for _, _, s in rows))
    share = mixing.quotas(weights, 64)
    order = sorted({(r.mix_slot, r.source or "") for r in got if r.in_mix})
    assert [t for t, _ in order] == list(range(len(order)))
    done = Counter()
    for t, s in order:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * a / 64) < 1 for x, a in share.items())
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"hot": 1.0})
    assert mixing.mix(docs.where("false")).count() == 0


def test_exact_mix_stays_within_a_block_of_the_targets(spark):
    rng = np.random.default_rng(16)
    for weights in ({f"s{k}": 1.0 for k in range(20)}, {f"s{k}": float(w) for k, w in enumerate(rng.random(30) ** 3 + 1e-4)}):
        whole, done, t = sum(weights.values()), Counter(), 0
        for rows in mixing.exact_schedule(weights, {s: 4000 if len(weights) == 20 else int(40_000 * w / whole) + 1 for s, w in weights.items()}, 1000):
            for s, i, slot in rows:
                assert slot == t and i == done[s]
                done[s] += 1
                t += 1
                assert all(abs(done[x] - t * w / whole) < 1 + 1e-6 for x, w in weights.items())
        assert t > 20_000
    docs = docs_of(spark, [(i, "t", f"s{i % 20}" if i % 3 else "big") for i in range(6000)])
    got = mixing.mix(docs, block_docs=1, weights={"big": 2.0} | {f"s{k}": 1.0 for k in range(20)}, period=64, exact=True).collect()
    assert len(got) == 6000 and max(Counter((r.mix_slot, r.mix_place) for r in got).values()) == 1
    inside = sorted((r.mix_slot, r.source) for r in got if r.in_mix)
    assert [t for t, _ in inside] == list(range(len(inside))) and len(inside) > 2000
    done = Counter()
    for t, s in inside:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * (2 if x == "big" else 1) / 22) < 1 for x in {r.source for r in got})
    assert mixing.mix(docs.where("false"), exact=True).count() == 0


# WARC


def test_warc_round_trip_and_lookup(spark):
    rows = [(i, f"https://{'www' if i % 2 else 'm'}.host{i % 5}.example.com/p/{i}?q={i}#f", f"<html>päge {i % 17}</html>") for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "no-scheme", "x" * 2_000_000), (7, rows[7][1], rows[7][2]), (None, "https://a.b/c d", "<html>päge 3</html>"), (303, rows[3][1], "other payload")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    a = warc.archive(pages)
    got = a.records().collect()
    holder = {}
    for i, _, html in rows:
        if i is not None:
            holder[html or ""] = max(holder.get(html or "", i), i)
    want = Counter()
    for i, _, html in rows:
        h = holder[html or ""]
        want[(i, len((html or "").encode()), warc.base32_sha1((html or "").encode()), "response" if i == h else "revisit", None if i == h else h)] += 1
    assert Counter(tuple(r) for r in got) == want
    found = a.fetch(rows[3][1])
    assert {r.fields["X-Page-ID"] for r in found} == {"3", "303"}
    assert a.fetch(rows[199][1])[0].payload.decode() == rows[199][2]
    assert a.fetch("https://nowhere.example.com/") == []
    assert Counter(tuple(r) for r in a.records(urls=pages).collect()) == want
    revisit = a.fetch(rows[3][1])
    assert {(r.fields["WARC-Type"], r.payload.decode()) for r in revisit} == {("revisit", rows[3][2]), ("response", "other payload")}
    low, high = warc.surt("https://m.host2.example.com/"), warc.surt("https://www.host2.example.com/zzz")
    inside = {r.page_id for r in a.all_captures(low, high).collect()}
    assert inside == {i for i, u, _ in rows if low <= warc.surt(u) <= high}
    small = warc.archive(spark.createDataFrame([(1, "u://a/", "ab"), (2, "u://a/", "ab"), (3, "u://b/", "abcd"), (4, "u://b/", "abcd")], "page_id long, url string, html string"), least_bytes=3)
    assert {r.page_id: r.record_type for r in small.records().collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = warc.archive(pages.where("false"))
    assert empty.records().count() == 0 and empty.fetch("x://y/") == []


def test_index_bisects_blocks(spark):
    captures = spark.createDataFrame([(f"k{i // 3:05d}", i, "f", i, 1) for i in range(2000)], warc.CAPTURES)
    root = warc.fresh_path(spark, "cdx")
    manifest = warc.write_index(captures.repartition(4), root, block_lines=50)
    a = warc.Archive("unused", root, manifest)
    assert sorted(r.page_id for r in a.all_captures("k00100", "k00102").collect()) == list(range(300, 309))
    assert a.all_captures().count() == 2000
    # a key may run through several parts, and one part may hold many keys
    hot = spark.createDataFrame([("hot", i, "f", i, 1) for i in range(900)] + [(f"z{i}", i, "f", i, 1) for i in range(50)], warc.CAPTURES)
    root = warc.fresh_path(spark, "cdx")
    b = warc.Archive("unused", root, warc.write_index(hot.repartition(4), root, block_lines=20))
    urls = spark.createDataFrame([("hot",), ("hot",), ("z7",), ("nothing",), (None,)], "url string")
    assert Counter((r.surt, r.page_id) for r in b.lookup(urls).collect()) == Counter([("hot", i) for i in range(900)] + [("z7", 7)])


def test_a_payload_that_a_third_of_the_pages_share_is_joined_in_parts(spark):
    rows = [(i, f"https://h.example/{i}", "same" if i % 3 else f"own {i}") for i in range(600)]
    got = warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.refers_to) for r in got) == Counter((i, 599 if h == "same" and i != 599 else None) for i, _, h in rows)


def test_broken_records_are_noticed():
    raw = warc.record(1, "u://x/", b"payload", None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw).payload == b"payload"
    for bad in (raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), raw[:-4], raw.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


# URL rules


def test_url_parts_and_rules(spark):
    from inkfold.llm.queries import URL_RULES

    cases = [
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://b.org", "b.org", "", None, "allow"), ("https://b.org/", "b.org", "/", "org/", "allow"),
        ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("x://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"), ("x://c.com/de/#z", "c.com", "/de/", "com/de/", "block"),
        ("x://h?p=://q", "h", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://É.com/fr/É", "É.com", "/fr/É", "com/fr/", "allow"), ("x://a\nb.com/de/\nx", "a\nb.com", "/de/\nx", "com/de/", "block"),
    ]
    pages = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, URL_RULES).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_mined_rules_match_brute_force(spark):
    rows = [(i, f"https://{'casino' if i % 4 == 0 else 'news'}-{i % 3}.example.{'net' if i % 2 else 'com'}/{'de' if i % 5 else 'fr'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urlrules.judge(pages, [], min_support=0.02, min_rows=5).collect()
    assert all(r.verdict == ("block" if r.page_id % 4 == 0 else "allow") for r in got)
    assert any(r.mined_rule == "h:casino" for r in got)
    assert urlrules.judge(pages.where("false"), []).count() == 0


def test_long_url_templates_are_mined(spark):
    template = "/".join(f"part{k}" for k in range(40))
    rows = [(i, f"https://{'casino' if i % 2 else 'news'}.example.net/{template}/{i}") for i in range(60)]
    rows += [(100 + i, f"https://other{i}.example.com/x{i}") for i in range(100)] + [(300, "https://"), (301, None), (302, "http://a.b/" + "/".join(f"once{k}" for k in range(3000)))]
    got = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string"), [], min_support=0.02, min_rows=5).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(60)) and got[1].mined_rule == "h:casino"
    assert all(got[i].verdict == "allow" and got[i].mined_rule is None for i in (300, 301))


def test_rules_hold_on_hosts_that_were_not_labelled(spark):
    """Rules of the labels of half of the hosts decide the others: verdicts are of tokens, not of hosts."""
    kinds = ("casino", "bets", "news", "shop")
    rows = [(i, f"https://{kinds[i % 4]}-{i % 37}.example.{'net' if i % 3 else 'com'}/{'slots' if i % 4 < 2 else 'read'}/{i}") for i in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    read = pages.select("page_id", urlrules.host_of("url").alias("host"), urlrules.path_of("url").alias("path")).withColumn("tokens", urlrules.tokens())
    seen = F.crc32("host") % 2 == 0
    labelled = read.where(seen).select("tokens", F.coalesce(urlrules.seed_label(), F.lit("allow")).alias("label"))
    rules = urlrules.mine(labelled, 0.02, 5, 0.8, 3, 2000)
    # a path part that goes with the seed words is a rule of its own
    assert {("p:slots",), ("p:read",)} <= {tuple(t) for t, *_ in rules}
    hidden = read.where(~seen).withColumn("tokens", F.filter("tokens", lambda t: ~t.isin("h:casino", "h:bets")))
    got = urlrules.match(hidden.select("tokens").distinct(), rules).join(hidden, "tokens").collect()
    assert len(got) == hidden.count() and all((r.mined_verdict == "block") == (r.page_id % 4 < 2) for r in got)


# nearest neighbours


def exact(rows, query, k):
    x = {i: np.array(v, float) for i, v in rows}
    return sorted((float(np.sqrt(((v - x[query]) ** 2).sum())), i) for i, v in x.items() if i != query)[:k]


def test_ann_small_is_exact_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(50)] + [(2000, [1.0] * 5), (2001, [0.5] * 5)]
    bad = [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] + [1.0] * 7), (3003, [float("inf")] + [1.0] * 7), (3004, [None] + [1.0] * 7), (3005, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0 or vec_id is null"), k=10, shard_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    same = [x for x in rows if len(x[1]) == 8]
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    for q, found in got.items():
        want = exact(same if q != 2000 else [x for x in rows if len(x[1]) == 5], q, 10)
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(want) + 1))
        assert [i for _, _, i in sorted(found)] == [i for _, i in want]
        assert np.allclose([s for _, s, _ in sorted(found)], [s for s, _ in want], rtol=1e-12)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(20, 32))[rng.integers(0, 20, 4000)] + 0.4 * rng.normal(size=(4000, 32))).astype(np.float32)
    graph = ann.build(x)
    queries = x[::40] + 0.05 * rng.normal(size=(100, 32)).astype(np.float32)
    found = ann.search(graph, queries, 10, 128)
    want = np.argsort(((queries[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want)]) > 0.95
    assert len(graph.levels) > 1 and graph.levels[0][1].shape[1] == 34
