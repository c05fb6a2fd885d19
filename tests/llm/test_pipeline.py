"""The pipeline's stages on the smallest tables, each against what it must keep."""

from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from inkfold.llm import queries, simhash
from inkfold.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if label[a] != label[b] and alike(sets[a], sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_stages_in_order(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    docs = table(spark, DATA, "documents")
    schema = docs.schema
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test-stage")
        if name != names[-1]:
            assert docs.schema.simpleString() == schema.simpleString()
        seen.append(docs.toPandas())
    source, good, lines, unique, clean, mixed = seen
    quality = queries.QUERIES["op9_quality_gam"](spark, DATA).toPandas().set_index("doc_id").predicted
    assert set(good.doc_id) == set(quality[quality == 1].index)
    assert Counter(lines.doc_id) == Counter(good.doc_id)
    assert set(lines.merge(good, on="doc_id").query("text_x != text_y").doc_id) <= set(good.doc_id)
    label = groups(list(zip(lines.doc_id, lines.text)))
    assert set(unique.doc_id) == {i for i, c in label.items() if i == c}
    leaks = queries.QUERIES["op6_decontamination_qgram"](spark, DATA).toPandas()
    assert set(unique.doc_id) - set(clean.doc_id) <= set(leaks.doc_id)
    assert sorted(mixed.doc_id) == sorted(clean.doc_id) and mixed.groupby(["mix_slot", "mix_place"]).size().max() == 1
    again = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(map(tuple, again[["doc_id", "mix_slot", "mix_place"]].values)) == sorted(map(tuple, mixed[["doc_id", "mix_slot", "mix_place"]].values))


def test_drop_copies_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(500)]
    rows = []
    for g in range(25):
        base = [vocabulary[k] for k in rng.integers(0, 500, int(rng.integers(60, 300)))]
        for c in range(int(rng.integers(1, 6))):
            edited = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                edited[int(rng.integers(0, len(base)))] = "edit"
            rows.append((100 * g + c, " ".join(edited)))
    rows += [(9000, ""), (9001, " \n "), (9002, None), (9003, "one"), (9004, "one"), (9005, "a b c d"), (9006, "A B C D")]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS fp", "'x' AS id")
    got = simhash.drop_copies(docs, tile_rows=16)
    assert got.columns == docs.columns
    label = groups(rows)
    want = Counter(i for i, c in label.items() if i == c)
    want[rows[0][0]] += 1 if label[rows[0][0]] == rows[0][0] else 0
    # texts without words count as one group
    want[9001] = want[9002] = 0
    want[None] = 1
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert simhash.drop_copies(docs.where("false")).count() == 0


def test_drop_copies_keeps_unlike_texts_of_equal_fingerprints(spark):
    filler = "so it goes on and " * 100
    rows = [(k, filler + " ".join(f"w{k}x{i}" for i in range(40))) for k in range(6)] + [(9, filler + " ".join(f"w0x{i}" for i in range(40)))]
    hashes = [simhash.shingle_hashes(t.encode(), 5, 42) for _, t in rows]
    assert len({simhash.vote(h) for h in hashes}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_copies(docs).collect()) == list(range(6))


def test_drop_copies_within_a_template(spark):
    rng = np.random.default_rng(14)
    template = [f"t{k}" for k in range(250)]
    rows = []
    for g in range(60):
        own = [f"g{g}w{k}" for k in range(16)]
        for c in range(2):
            tail = [f"g{g}c{c}e{k}" for k in range(22)]
            rows.append((10 * g + c, " ".join(template + own + tail)))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    label = groups(rows)
    assert len(set(label.values())) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_copies(docs).collect()} == set(label.values())


def test_drop_copies_by_sets_whatever_repeats(spark):
    rng = np.random.default_rng(15)
    rows = []
    for g in range(10):
        text = " ".join(f"g{g}w{k}" for k in range(200))
        line = " ".join(f"g{g}l{k}" for k in range(20)) + " "
        rows += [(10 * g, f"{text} {line}"), (10 * g + 1, f"{text} {line * 10}"), (10 * g + 2, f"{text} {line * 20}")]
    for g in range(300):
        n = int(rng.integers(8, 25))
        words = [f"s{g}w{k}" for k in range(n + 3)]
        rows += [(1000 + 10 * g, " ".join(words[:n])), (1001 + 10 * g, " ".join(words[: n + 1])), (1002 + 10 * g, " ".join(words))]
    rows += [(9000 + k, f"c{k} " + " ".join(f"hot{i}" for i in range(23))) for k in range(40)]
    label = groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_copies(docs).collect()} == {i for i, c in label.items() if i == c}
    nodes = spark.createDataFrame([(k, 6, [k, 100, 101, 102, 103, 104, 105, 106, 107]) for k in range(50)], "id long, n long, few array<long>").selectExpr("id", "9L AS n", "few")
    edges = [tuple(sorted(r)) for r in simhash.few_links(nodes, 0.8, tile_rows=8).collect()]
    assert {x for e in edges for x in e} == set(range(50))


def test_drop_copies_judges_texts_of_one_id_apart(spark):
    text = lambda g: " ".join(f"g{g}w{k}" for k in range(60))
    rows = [(7, text(1)), (7, text(2)), (9, text(1) + " x"), (10, text(2) + " y"), (3, text(3)), (8, text(3) + " z"), (8, text(4))]
    got = simhash.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([(7, text(1)), (7, text(2)), (3, text(3)), (8, text(4))])


def test_a_spanning_forest_joins_what_all_edges_join():
    rng = np.random.default_rng(13)
    for _ in range(30):
        i, j = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
        far = i != j
        i, j = i[far], j[far]
        kept = simhash.spanning(i, j, 40)
        whole, part = (simhash.merged(np.arange(40), x, y) for x, y in ((i, j), (i[kept], j[kept])))
        assert (whole == part).all() and len(kept) == 40 - len(set(whole.tolist()))
        label = list(range(40))
        for a, b in zip(i, j):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        assert whole.tolist() == label


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in found.description)
    place = {c[0]: k for k, c in enumerate(found.description)}
    want = sorted(tuple(str(r[place[c]]) for c in names) for r in found.fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want
