"""Policy rules as ordered CASE expressions: the first failing gate names the verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Budgets, vocabularies and version strings.
MAX_INPUT_BYTES = 25 * 1024 * 1024
MAX_PAGES = 100
MAX_RENDER_PIXELS = 16 * 1024 * 1024
MAX_PAGE_DIMENSION_PT = 14400
MAX_OPERATORS_PER_PAGE = 2_000_000
MAX_CANDIDATE_BYTES = 64 * 1024 * 1024
HYBRID_IMAGE_COVERAGE = 0.8
LIMIT_LABELS = {
    "input-size": "25 MiB",
    "page-count": "100 pages",
    "render-surface": "16 megapixels",
    "page-dimension": "14,400 points",
    "operators": "2,000,000 operators",
}
SUPPORT_REASONS = (
    "wrong-type", "empty", "damaged", "locked", "signed", "xfa", "form-widget", "embedded-file", "js-actions", "rich-media",
    "scanned", "hybrid", "annotation-overlap", "hidden-layer", "over-limit", "disagreement", "unexpected",
)
SANITIZABLE_FINDINGS = ("embedded-files", "java-script")
CLASSIFIER_REASONS = {"not-a-pdf": "wrong-type", "encrypted": "locked", "corrupt": "damaged", "empty": "empty", "over-limit": "over-limit"}
ENGINE_ERRORS = {
    "PasswordException": "locked", "BudgetExceededError": "over-limit", "DescriptorError": "damaged",
    "InvalidPDFException": "damaged", "MissingPDFException": "damaged", "UnknownErrorException": "damaged",
}
TRANSFORM_FAILURES = ("precondition", "invalid-request", "engine-error", "save-failed", "self-check-failed", "timeout", "worker-error", "protocol", "internal")
VERIFY_OUTCOMES = {
    "digest-mismatch": "fail", "parse-error": "fail", "source-unavailable": "indeterminate", "budget-exhausted": "indeterminate",
    "timeout": "indeterminate", "worker-error": "indeterminate", "protocol": "indeterminate", "internal": "indeterminate",
}
VERSIONS = {
    "transformEngine": "mupdf/1.28.1", "verifyEngine": "pdfjs/6.3.289", "verifyPolicy": "verify-policy/1",
    "redactionPolicy": "redaction-policy/2", "savePolicy": "save/garbage+gc/1",
}
VISUAL_THRESHOLDS = {
    "visualScale": 2, "aaBoundaryPx": 2, "fillUniformityTolerance": 4, "fillBlackTolerance": 8,
    "retainedTolerance": 4, "outsideTolerance": 2, "glyphExclusionMarginPx": 3,
}


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.lit(default).cast("string")
    for k, v in values.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def over(value: Column, limit: float, kind: str) -> Column:
    """``kind`` above the limit, null at or below it."""
    return F.when(value > limit, kind)


def input_size(size: Column) -> Column:
    return over(size, MAX_INPUT_BYTES, "input-size")


def page_count(pages: Column) -> Column:
    return over(pages, MAX_PAGES, "page-count")


def page_dimension(width: Column, height: Column) -> Column:
    return over(F.greatest(width, height), MAX_PAGE_DIMENSION_PT, "page-dimension")


def image_pixels(pixels: Column) -> Column:
    return over(pixels, MAX_RENDER_PIXELS, "render-surface")


def operator_count(operators: Column) -> Column:
    return over(operators, MAX_OPERATORS_PER_PAGE, "operators")


def classified_page(width: Column, height: Column, pixels: Column) -> Column:
    """Dimension first, then image pixels."""
    return F.coalesce(page_dimension(width, height), image_pixels(pixels))


def page_kind(has_text: Column, image_blocks: Column, coverage: Column) -> Column:
    """blank, scanned, hybrid or text_based. A coverage that is no number counts as none."""
    share = F.when(F.isnan(coverage) | coverage.isNull() | (F.abs(coverage) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage)))
    return (
        F.when(~has_text & ~(image_blocks > 0), "blank").when(~has_text, "scanned")
        .when(share >= HYBRID_IMAGE_COVERAGE, "hybrid").otherwise("text_based")
    )


def feature_reason() -> Column:
    """The feature that rejects a document; null where only sanitizable ones remain."""
    return (
        F.when(F.col("xfa"), "xfa").when(F.col("signed"), "signed").when(F.col("form_widgets"), "form-widget")
        .when(F.col("java_script_page"), "js-actions").when(F.col("rich_media"), "rich-media")
    )


def soft_findings() -> Column:
    return F.filter(F.array(F.when(F.col("embedded_files"), SANITIZABLE_FINDINGS[0]), F.when(F.col("java_script_document"), SANITIZABLE_FINDINGS[1])), lambda x: x.isNotNull())


def any_feature() -> Column:
    return F.col("xfa") | F.col("form_widgets") | F.col("signed") | F.col("embedded_files") | F.col("java_script_page") | F.col("java_script_document") | F.col("rich_media")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def precheck(content: Column) -> Column:
    """wrong-type without the magic bytes, xfa where an XFA key is mentioned, else null."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(~is_pdf(content), "wrong-type").when(text.rlike(r"/XFA(?=[\s<>\[\]()/])"), "xfa")


def outcome_rank(outcome: Column) -> Column:
    return F.when(outcome == "fail", 2).when(outcome == "indeterminate", 1).otherwise(0)


def outcome_of(rank: Column) -> Column:
    return F.when(rank == 2, "fail").when(rank == 1, "indeterminate").otherwise("pass")
