import pytest
from pyspark.sql import functions as F

from inkfold.functions import policy as pol
from inkfold.functions import text as tx
from inkfold.operators import intake as it
from inkfold.operators import verification as ver
from inkfold.operators import visual as vis
from inkfold.sources.sinks import canonical_json


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("rule,limit,kind", [
    (pol.input_size, pol.MAX_INPUT_BYTES, "input-size"), (pol.page_count, 100, "page-count"), (pol.image_pixels, pol.MAX_RENDER_PIXELS, "render-surface"), (pol.operator_count, 2_000_000, "operators"),
])
def test_limit_itself_passes(spark, rule, limit, kind):
    assert value(spark, rule(F.lit(limit))) is None
    assert value(spark, rule(F.lit(limit + 1))) == kind


@pytest.mark.parametrize("text,images,coverage,kind", [
    (True, 1, 0.8, "hybrid"), (True, 1, 0.799, "text_based"), (True, 1, float("nan"), "text_based"), (True, 0, float("inf"), "text_based"),
    (False, 0, 0.9, "blank"), (False, 2, 0.0, "scanned"), (True, 1, 7.0, "hybrid"),
])
def test_page_kind(spark, text, images, coverage, kind):
    assert value(spark, pol.page_kind(F.lit(text), F.lit(images), F.lit(coverage))) == kind


FLAGS = ["xfa", "signed", "form_widgets", "java_script_page", "rich_media", "embedded_files", "java_script_document"]


def test_feature_precedence(spark):
    rows = [tuple(j >= i for j in range(7)) for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in FLAGS))
    got = df.select(pol.feature_reason().alias("r"), pol.soft_findings().alias("s")).collect()
    assert [g.r for g in got] == ["xfa", "signed", "form-widget", "js-actions", "rich-media", None, None, None]
    assert [g.s for g in got[5:]] == [["embedded-files", "java-script"], ["java-script"], []]


def test_precheck(spark):
    rows = [(b"%PDF-1.7 /XFA [", "xfa"), (b"%PDF-1.7 /XFAB", None), (b"%PDF", "wrong-type"), (b"", "wrong-type"), (None, "wrong-type"), (b"x%PDF-", "wrong-type")]
    df = spark.createDataFrame([(r[0], r[1] or "none") for r in rows], "content binary, want string")
    for r in df.select(F.coalesce(pol.precheck(F.col("content")), F.lit("none")).alias("got"), "want").collect():
        assert r.got == r.want


def test_document_kinds_number_pages_from_one(spark):
    df = spark.createDataFrame([(1, 0, "scanned"), (1, 2, "scanned"), (1, 1, "hybrid"), (2, 0, "hybrid"), (3, 0, "blank")], "doc_id long, page_index long, kind string")
    got = {r.doc_id: (r.supported, r.reason, r.page_numbers) for r in it.document_kinds(df).collect()}
    assert got == {1: (False, "scanned", "1,3"), 2: (False, "hybrid", "1"), 3: (True, None, "")}


def test_sanitize_order(spark):
    schema = "doc_id long, info string, root string, metadata string, names string, embedded_files string, java_script string, dests string, open_action string, aa string"
    rows = [
        (1, "dict", "dict", "stream", "dict", "dict", "dict", "dict", "array", "dict"), (2, "other", None, None, None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None, None), (4, None, "dict", "dict", None, None, None, "dict", None, "other"),
    ]
    got = {r.doc_id: r for r in it.sanitized(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].error is None and [got[1][c] for c in ("info", "metadata", "open_action", "aa", "embedded_files", "java_script")] == [None] * 6 and got[1].dests == "dict"
    assert [got[k].error for k in (2, 3, 4)] == ["sanitize:info-not-a-dictionary", "sanitize:no-root", "sanitize:metadata-not-a-stream"]
    assert got[4].aa == "other"


def test_missing_aspect_is_indeterminate(spark):
    asked = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 0)], "doc_id long, mark_no long, page_index long")
    checks = spark.createDataFrame(
        [(1, 1, "text", "pass", "t"), (1, 1, "visual", "fail", "v"), (1, 2, "text", "fail", "t"), (1, 4, "text", "pass", "t"), (1, 4, "visual", "indeterminate", "v")],
        "doc_id long, mark_no long, aspect string, outcome string, reason_code string",
    )
    got = {r.mark_no: (r.outcome, r.reason_code) for r in ver.assembled_selections(asked, checks).collect()}
    assert got == {1: ("fail", "v"), 2: ("indeterminate", "verify.report.aspect-missing"), 3: ("indeterminate", "verify.report.selection-missing"), 4: ("indeterminate", "v")}


def test_outside_fold_keeps_first_reason(spark):
    rows = [(1, 0, "pass", "a"), (1, 1, "indeterminate", "b"), (1, 2, "fail", "c"), (1, 3, "fail", "d"), (2, 0, "pass", "a")]
    got = {r.doc_id: (r.outcome, r.reason_code) for r in ver.outside_fold(spark.createDataFrame(rows, "doc_id long, ord int, outcome string, reason_code string")).collect()}
    assert got == {1: ("fail", "c"), 2: ("pass", "verify.visual.outside-ok")}


def test_fill_verdicts(spark):
    def raster(r, cand, src=200):
        return [(r, x, y, src, cand(x, y)) for x in range(8) for y in range(8)]

    rows = raster(1, lambda x, y: 0) + raster(2, lambda x, y: 40) + raster(3, lambda x, y: 9 * x) + raster(4, lambda x, y: 8, 9) + raster(5, lambda x, y: 3, 4)
    got = {r.r: r.reason_code.removeprefix("verify.visual.") for r in vis.fill_verdicts(spark.createDataFrame(rows, "r long, x int, y int, src long, cand long"), (2, 2, 6, 6)).collect()}
    assert got == {1: "fill-ok", 2: "unexpected-fill", 3: "non-uniform-fill", 4: "retained-pixels", 5: "fill-ok"}


def test_text_values(spark):
    df = spark.createDataFrame([("a  \tb​",), ("é",), ("​ ",), (None,)], "s string")
    got = [r.v for r in tx.normalized_values(df, "s", "v").collect()]
    assert sorted(x for x in got if x is not None) == ["", "a b", "é"] and got.count(None) == 1


def test_canonical_json_sorts_and_drops(spark):
    assert value(spark, canonical_json(b=F.lit(1), a=F.lit("x"), c=F.lit(None).cast("string"))) == '{"a":"x","b":1}'
