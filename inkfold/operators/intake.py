"""Intake: comparing the page lists of two engines, page and document kinds, features and their order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import policy as pol
from inkfold.functions.geometry import GEOMETRY_EPSILON_PT


def compare_engines(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """doc_id, agreed: both lists have the same pages and agree on each. A full outer join on the page,
    so a page that either side lacks counts as disagreement and no document is lost."""
    a = ours.select("doc_id", "page_index", *[F.col(c).alias(f"a_{c}") for c in ("rotation", "user_unit", "cx0", "cy0", "cx1", "cy1", "has_text")])
    b = theirs.select("doc_id", "page_index", *[F.col(c).alias(f"b_{c}") for c in theirs.columns if c not in ("doc_id", "page_index")])
    w, h = F.col("a_cx1") - F.col("a_cx0"), F.col("a_cy1") - F.col("a_cy0")
    turned = F.col("b_rotation").isin(90, 270)
    uw, uh = F.col("b_width") / F.col("b_user_unit"), F.col("b_height") / F.col("b_user_unit")

    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) <= GEOMETRY_EPSILON_PT

    same = (
        (F.col("a_rotation") == F.col("b_rotation")) & (F.col("a_user_unit") == F.col("b_user_unit")) & (F.col("b_user_unit") > 0)
        & (w > 0) & (h > 0) & (uw > 0) & (uh > 0) & near(uw, F.when(turned, h).otherwise(w)) & near(uh, F.when(turned, w).otherwise(h))
        & (F.col("b_width") - F.col("b_media_width") <= GEOMETRY_EPSILON_PT) & (F.col("b_height") - F.col("b_media_height") <= GEOMETRY_EPSILON_PT)
        & (F.col("a_has_text") == (F.col("b_text_chars") > 0))
        & (F.col("b_image_blocks") >= 0) & F.col("b_image_coverage").between(0.0, 1.0)
    )
    return a.join(b, ["doc_id", "page_index"], "full").groupBy("doc_id").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("agreed"))


def page_kinds(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_index", pol.page_kind(F.col("has_text"), F.col("image_blocks"), F.col("image_coverage")).alias("kind"))


def document_kinds(kinds: DataFrame) -> DataFrame:
    """doc_id, supported, reason, page_numbers (from 1, comma-joined): scanned pages decide before hybrid ones."""

    def pages_of(kind: str) -> Column:
        listed = F.expr(f"listagg(CASE WHEN kind = '{kind}' THEN CAST(page_index + 1 AS STRING) END, ',') WITHIN GROUP (ORDER BY page_index)")
        return F.nullif(F.coalesce(listed, F.lit("")), F.lit(""))

    found = kinds.groupBy("doc_id").agg(pages_of("scanned").alias("scanned"), pages_of("hybrid").alias("hybrid"))
    reason = F.when(F.col("scanned").isNotNull(), "scanned").when(F.col("hybrid").isNotNull(), "hybrid")
    return found.select("doc_id", reason.isNull().alias("supported"), reason.alias("reason"), F.coalesce("scanned", "hybrid", F.lit("")).alias("page_numbers"))


def page_gates(pages: DataFrame) -> DataFrame:
    """Each page's first exceeded budget, null within all of them: dimension, image pixels, operators."""
    w, h = (F.col("cx1") - F.col("cx0")) * F.col("user_unit"), (F.col("cy1") - F.col("cy0")) * F.col("user_unit")
    kind = F.coalesce(pol.classified_page(w, h, F.col("max_image_pixels")), pol.operator_count(F.col("operators")))
    return pages.select("doc_id", "page_index", kind.alias("kind"))


def intake_verdicts(docs: DataFrame, pages: DataFrame, theirs: DataFrame, features: DataFrame) -> DataFrame:
    """doc_id, outcome, reason_code, page_numbers, limit_label, findings. docs: doc_id, magic, byte_length.
    The first failing gate in policy order decides; a document that any table lacks is not dropped."""
    gates = page_gates(pages).where("kind is not null").groupBy("doc_id").agg(F.min(F.struct("page_index", "kind")).alias("gate"))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    feature = features.select("doc_id", pol.feature_reason().alias("feature"), F.array_join(pol.soft_findings(), ",").alias("found"))
    kinds = document_kinds(page_kinds(pages)).withColumnRenamed("reason", "kind_reason")
    all_ = docs
    for other in (counts, gates, feature, kinds, compare_engines(pages, theirs)):
        all_ = all_.join(other, "doc_id", "left")
    size_kind = pol.input_size(F.col("byte_length"))
    count_kind = pol.page_count(F.col("page_count"))
    limit = F.coalesce(size_kind, count_kind, F.col("gate.kind"))
    reason = (
        F.when(~F.col("magic"), "wrong-type").when(size_kind.isNotNull(), "over-limit")
        .when(F.coalesce(F.col("page_count"), F.lit(0)) == 0, "empty").when(count_kind.isNotNull() | F.col("gate").isNotNull(), "over-limit")
        .when(F.col("feature").isNotNull(), F.col("feature")).when(~F.coalesce(F.col("agreed"), F.lit(False)), "disagreement").otherwise(F.col("kind_reason"))
    )
    out = all_.withColumn("reason_code", reason).withColumn("limit", F.when(F.col("reason_code") == "over-limit", limit))
    numbers = F.when(F.col("reason_code").isin("scanned", "hybrid"), F.col("page_numbers")).when(
        (F.col("reason_code") == "over-limit") & size_kind.isNull() & count_kind.isNull(), (F.col("gate.page_index") + 1).cast("string")
    ).otherwise("")
    return out.select(
        "doc_id", F.when(F.col("reason_code").isNull(), "supported").otherwise("rejected").alias("outcome"), "reason_code", numbers.alias("page_numbers"),
        pol.lookup(pol.LIMIT_LABELS, F.col("limit")).alias("limit_label"), F.when(F.col("reason_code").isNull(), F.coalesce("found", F.lit(""))).otherwise("").alias("findings"),
    )


def markup_verdicts(marks: DataFrame, annotations: DataFrame, markup: DataFrame) -> DataFrame:
    """Each mark clear or not: unknown evidence and overlapping annotations first, then optional content."""
    from inkfold.functions.geometry import columns
    from inkfold.functions.predicates import overlaps

    a = annotations.select(*[F.col(c).alias(f"a_{c}") for c in annotations.columns])
    on = (marks.doc_id == a.a_doc_id) & (marks.page_index == a.a_page_index) & overlaps(columns(), columns("a_"))
    hit = marks.join(a, on, "left_semi").select("doc_id", "mark_no", F.lit(True).alias("annotated"))
    all_ = marks.join(hit, ["doc_id", "mark_no"], "left").join(markup, ["doc_id", "page_index"], "left")
    reason = F.when(F.coalesce("indeterminate", F.lit(True)) | F.coalesce("annotated", F.lit(False)), "annotation-overlap").when(F.col("optional_content"), "hidden-layer")
    return all_.select("doc_id", "mark_no", reason.isNull().alias("is_clear"), reason.alias("reason"))


def sanitized(dictionaries: DataFrame) -> DataFrame:
    """doc_id, error and the kind of each entry that is left; a malformed entry is an error and keeps all.
    Entries are judged in the order they are removed."""
    gone_tree = F.col("names").isNotNull()

    def malformed(entry: str, kind: str, among: Column | None = None) -> Column:
        found = F.col(entry).isNotNull() & (F.col(entry) != kind)
        return found if among is None else among & found

    error = (
        F.when(malformed("info", "dict"), "sanitize:info-not-a-dictionary").when(F.col("root").isNull(), "sanitize:no-root")
        .when(malformed("root", "dict"), "sanitize:root-not-a-dictionary").when(malformed("metadata", "stream"), "sanitize:metadata-not-a-stream")
        .when(malformed("names", "dict"), "sanitize:names-not-a-dictionary").when(malformed("embedded_files", "dict", gone_tree), "sanitize:names-EmbeddedFiles-not-a-dictionary")
        .when(malformed("java_script", "dict", gone_tree), "sanitize:names-JavaScript-not-a-dictionary").when(malformed("aa", "dict"), "sanitize:aa-not-a-dictionary")
    )
    out = dictionaries.withColumn("error", error)
    cleared = [F.when(F.col("error").isNotNull(), F.col(c)).alias(c) for c in ("info", "metadata", "open_action", "aa")]
    trees = [F.when(F.col("error").isNotNull() | F.col("names").isNull(), F.col(c)).alias(c) for c in ("embedded_files", "java_script")]
    return out.select("doc_id", "error", *cleared, *trees, "dests")
