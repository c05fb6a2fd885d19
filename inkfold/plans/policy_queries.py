"""Queries over support policy: budgets, engine comparison, kinds, features, intake and preconditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions import policy as pol
from inkfold.operators import intake as it
from inkfold.plans import geometry_queries as gq
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev
from inkfold.sources.sinks import content_identity
from inkfold.sources.tables import table


def _case(values: dict[str, str], key: str, default: str | None = None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + (f" ELSE '{default}'" if default else "") + " END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LABEL = _case(pol.LIMIT_LABELS, "kind")


@query(
    "budget_gates",
    with_(
        f"""SELECT doc_id, kind, {_LABEL} AS label FROM (SELECT doc_id, CASE WHEN byte_length > 26214400 THEN 'input-size' WHEN page_count > 100 THEN 'page-count' END AS kind
        FROM (SELECT doc_id, any_value(byte_length) AS byte_length, count(*) AS page_count FROM pages_ GROUP BY doc_id))""",
        "pages_",
    ),
)
def budget_gates(spark, d):
    docs = ev.page_evidence(spark, d).groupBy("doc_id").agg(F.max("byte_length").alias("byte_length"), F.count("*").alias("page_count"))
    kind = F.coalesce(pol.input_size(F.col("byte_length")), pol.page_count(F.col("page_count")))
    return docs.withColumn("kind", kind).select("doc_id", "kind", pol.lookup(pol.LIMIT_LABELS, F.col("kind")).alias("label"))


_GATES = """SELECT doc_id, page_index, CASE WHEN greatest((cx1 - cx0) * user_unit, (cy1 - cy0) * user_unit) > 14400 THEN 'page-dimension'
  WHEN max_image_pixels > 16777216 THEN 'render-surface' WHEN operators > 2000000 THEN 'operators' END AS kind FROM pages_"""


@query("page_budgets", with_(f"SELECT doc_id, page_index, kind, {_LABEL} AS label FROM ({_GATES})", "pages_"))
def page_budgets(spark, d):
    return it.page_gates(ev.page_evidence(spark, d)).withColumn("label", pol.lookup(pol.LIMIT_LABELS, F.col("kind")))


@query(
    "page_content_evidence",
    with_(
        """SELECT doc_id, page_index, any_value(chars) AS chars, CAST(count(k) AS BIGINT) AS image_blocks, round(least(1, coalesce(sum((100 + 50 * ((doc_id + k) % 7)) * (120 + 40 * ((page_index + k) % 9))), 0) / any_value(area)), 6) AS image_coverage,
        coalesce(max((100 + 50 * ((doc_id + k) % 7)) * (120 + 40 * ((page_index + k) % 9))), 0) :: BIGINT AS max_image_pixels
        FROM (SELECT doc_id, page_index, tokens AS chars, (cx1 - cx0) * (cy1 - cy0) AS area, unnest(CASE WHEN (doc_id + page_index) % 4 = 0 THEN [NULL] ELSE range((doc_id + page_index) % 4) END) AS k FROM pages_) GROUP BY doc_id, page_index""",
        "pages_",
    ),
)
def page_content_evidence(spark, d):
    blocks = F.expr("(doc_id + page_index) % 4")
    ks = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks - 1))
    images = ev.page_evidence(spark, d).select("doc_id", "page_index", "tokens", ((F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))).alias("area"), F.explode_outer(ks).alias("k"))
    size = F.expr("(100 + 50 * ((doc_id + k) % 7)) * (120 + 40 * ((page_index + k) % 9))")
    return images.groupBy("doc_id", "page_index").agg(
        F.max("tokens").alias("chars"), F.count("k").alias("image_blocks"), F.round(F.least(F.lit(1.0), F.coalesce(F.sum(size), F.lit(0)) / F.max("area")), 6).alias("image_coverage"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_image_pixels"),
    )


_AGREED = """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, bool_and(coalesce(a.rotation = b.rotation AND a.user_unit = b.user_unit AND b.width > 0 AND b.height > 0
  AND abs(b.width / b.user_unit - CASE WHEN b.rotation IN (90, 270) THEN a.cy1 - a.cy0 ELSE a.cx1 - a.cx0 END) <= 0.02e0
  AND abs(b.height / b.user_unit - CASE WHEN b.rotation IN (90, 270) THEN a.cx1 - a.cx0 ELSE a.cy1 - a.cy0 END) <= 0.02e0
  AND b.width - b.media_width <= 0.02e0 AND b.height - b.media_height <= 0.02e0 AND a.has_text = (b.text_chars > 0) AND b.image_coverage BETWEEN 0 AND 1, false)) AS agreed
  FROM pages_ a FULL JOIN engine b ON a.doc_id = b.doc_id AND a.page_index = b.page_index GROUP BY 1"""


@query("engine_comparison", with_(f"SELECT doc_id, agreed, CASE WHEN NOT agreed THEN 'disagreement' END AS reason FROM ({_AGREED})", "pages_", "engine"))
def engine_comparison(spark, d):
    out = it.compare_engines(ev.page_evidence(spark, d), ev.engine_pages(spark, d))
    return out.withColumn("reason", F.when(~F.col("agreed"), "disagreement"))


_KINDS = """SELECT doc_id, page_index, CASE WHEN NOT has_text AND image_blocks = 0 THEN 'blank' WHEN NOT has_text THEN 'scanned' WHEN image_coverage >= 0.8e0 THEN 'hybrid' ELSE 'text_based' END AS kind FROM pages_"""
_DOCKINDS = f"""SELECT doc_id, scanned IS NULL AND hybrid IS NULL AS supported, CASE WHEN scanned IS NOT NULL THEN 'scanned' WHEN hybrid IS NOT NULL THEN 'hybrid' END AS reason, coalesce(scanned, hybrid, '') AS page_numbers
  FROM (SELECT doc_id, string_agg(CAST(page_index + 1 AS VARCHAR), ',' ORDER BY page_index) FILTER (WHERE kind = 'scanned') AS scanned,
  string_agg(CAST(page_index + 1 AS VARCHAR), ',' ORDER BY page_index) FILTER (WHERE kind = 'hybrid') AS hybrid FROM ({_KINDS}) GROUP BY doc_id)"""


@query("page_kinds", with_(_KINDS, "pages_"))
def page_kinds(spark, d):
    return it.page_kinds(ev.page_evidence(spark, d))


@query("document_kinds", with_(_DOCKINDS, "pages_"))
def document_kinds(spark, d):
    return it.document_kinds(it.page_kinds(ev.page_evidence(spark, d)))


_FEATURE = "CASE WHEN xfa THEN 'xfa' WHEN signed THEN 'signed' WHEN form_widgets THEN 'form-widget' WHEN java_script_page THEN 'js-actions' WHEN rich_media THEN 'rich-media' END"
_SOFT = "concat_ws(',', CASE WHEN embedded_files THEN 'embedded-files' END, CASE WHEN java_script_document THEN 'java-script' END)"


@query("feature_verdicts", with_(f"SELECT doc_id, {_FEATURE} IS NULL AS supported, {_FEATURE} AS reason, CASE WHEN {_FEATURE} IS NULL THEN {_SOFT} ELSE '' END AS findings FROM features", "features"))
def feature_verdicts(spark, d):
    out = ev.document_features(spark, d).withColumn("reason", pol.feature_reason())
    return out.select("doc_id", F.col("reason").isNull().alias("supported"), "reason", F.when(F.col("reason").isNull(), F.array_join(pol.soft_findings(), ",")).otherwise("").alias("findings"))


@query(
    "document_features",
    with_(
        """SELECT doc_id, coalesce(bool_or((doc_id * 7 + k) % 29 = 0), false) AS java_script_page, coalesce(bool_or((doc_id * 3 + k) % 23 = 0), false) AS rich_media, any_value(any_feature) AS any_feature
        FROM (SELECT doc_id, xfa OR signed OR form_widgets OR java_script_page OR rich_media OR embedded_files OR java_script_document AS any_feature, unnest(range(1 + doc_id % 5)) AS k FROM features) GROUP BY doc_id""",
        "features",
    ),
)
def document_features(spark, d):
    """Document features as the OR over its pages."""
    pages = ev.document_features(spark, d).select("doc_id", pol.any_feature().alias("any_feature"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("doc_id % 5"))).alias("k"))
    return pages.groupBy("doc_id").agg(
        F.bool_or(F.expr("(doc_id * 7 + k) % 29 = 0")).alias("java_script_page"), F.bool_or(F.expr("(doc_id * 3 + k) % 23 = 0")).alias("rich_media"), F.bool_or("any_feature").alias("any_feature"),
    )


@query(
    "source_precheck",
    """SELECT page_id AS doc_id, page_id % 4 = 0 AS is_pdf, CASE WHEN page_id % 4 <> 0 THEN 'wrong-type' WHEN page_id % 6 = 0 OR regexp_matches(html, '/XFA[\\s<>\\[\\]()/]') THEN 'xfa' END AS reason FROM pages""",
)
def source_precheck(spark, d):
    head = F.concat(F.when(F.expr("page_id % 4 = 0"), "%PDF-1.7\n").otherwise(""), F.when(F.expr("page_id % 6 = 0"), "/XFA [").otherwise("/XFAB "), F.col("html"))
    content = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), head.cast("binary").alias("content"))
    return content.select("doc_id", pol.is_pdf(F.col("content")).alias("is_pdf"), pol.precheck(F.col("content")).alias("reason"))


_CODES = [*pol.CLASSIFIER_REASONS, *pol.ENGINE_ERRORS, *pol.TRANSFORM_FAILURES, *pol.VERIFY_OUTCOMES, *pol.SUPPORT_REASONS, *pol.SANITIZABLE_FINDINGS]


@query(
    "failure_mapping",
    f"""SELECT event_id, code, {_case(pol.CLASSIFIER_REASONS, "code", "unexpected")} AS classifier_reason, {_case(pol.ENGINE_ERRORS, "code", "unexpected")} AS engine_reason,
    CASE WHEN code IN {_in(pol.ENGINE_ERRORS)} THEN 'rejected' ELSE 'indeterminate' END AS engine_outcome, {_case(pol.VERIFY_OUTCOMES, "code")} AS verify_outcome,
    code IN {_in(pol.SUPPORT_REASONS)} AS is_support_reason, code IN {_in(pol.SANITIZABLE_FINDINGS)} AS is_finding, code IN {_in(pol.TRANSFORM_FAILURES)} AS is_transform_failure, code IN {_in(pol.VERIFY_OUTCOMES)} AS is_verify_failure
    FROM (SELECT event_id, CASE WHEN event_id % 25 = 0 THEN 'code-' || event_id ELSE [{", ".join(f"'{c}'" for c in _CODES)}][event_id % {len(_CODES)} + 1] END AS code FROM events)""",
)
def failure_mapping(spark, d):
    code = F.when(F.expr("event_id % 25 = 0"), F.concat(F.lit("code-"), F.col("event_id").cast("string"))).otherwise(F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES) + 1).cast("int")))
    c = F.col("code")
    return table(spark, d, "events").select("event_id", code.alias("code")).select(
        "event_id", "code", pol.lookup(pol.CLASSIFIER_REASONS, c, "unexpected").alias("classifier_reason"), pol.lookup(pol.ENGINE_ERRORS, c, "unexpected").alias("engine_reason"),
        F.when(c.isin(*pol.ENGINE_ERRORS), "rejected").otherwise("indeterminate").alias("engine_outcome"), pol.lookup(pol.VERIFY_OUTCOMES, c).alias("verify_outcome"),
        c.isin(*pol.SUPPORT_REASONS).alias("is_support_reason"), c.isin(*pol.SANITIZABLE_FINDINGS).alias("is_finding"), c.isin(*pol.TRANSFORM_FAILURES).alias("is_transform_failure"), c.isin(*pol.VERIFY_OUTCOMES).alias("is_verify_failure"),
    )


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", (F.col("doc_id") % 43 != 0).alias("magic"), (F.col("n_chars") * 1000).alias("byte_length"))


@query(
    "intake_verdicts",
    with_(
        f"""SELECT doc_id, CASE WHEN reason_code IS NULL THEN 'supported' ELSE 'rejected' END AS outcome, reason_code,
        CASE WHEN reason_code IN ('scanned', 'hybrid') THEN page_numbers WHEN reason_code = 'over-limit' AND byte_length <= 26214400 AND n <= 100 THEN CAST(gp + 1 AS VARCHAR) ELSE '' END AS page_numbers,
        CASE WHEN reason_code = 'over-limit' THEN {_LABEL} END AS limit_label, CASE WHEN reason_code IS NULL THEN coalesce(soft, '') ELSE '' END AS findings
        FROM (SELECT *, CASE WHEN byte_length > 26214400 THEN 'input-size' WHEN n > 100 THEN 'page-count' ELSE gk END AS kind,
          CASE WHEN doc_id % 43 = 0 THEN 'wrong-type' WHEN byte_length > 26214400 THEN 'over-limit' WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n > 100 OR gk IS NOT NULL THEN 'over-limit'
          WHEN f IS NOT NULL THEN f WHEN NOT coalesce(agreed, false) THEN 'disagreement' ELSE kind_reason END AS reason_code
          FROM (SELECT d.doc_id, d.n_chars * 1000 AS byte_length, c.n, g.gp, g.gk, ft.f, ft.soft, dk.reason AS kind_reason, dk.page_numbers, ag.agreed FROM documents d
            LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT doc_id, min(page_index) AS gp, arg_min(kind, page_index) AS gk FROM ({_GATES}) WHERE kind IS NOT NULL GROUP BY doc_id) g USING (doc_id)
            LEFT JOIN (SELECT doc_id, {_FEATURE} AS f, {_SOFT} AS soft FROM features) ft USING (doc_id) LEFT JOIN ({_DOCKINDS}) dk USING (doc_id) LEFT JOIN ({_AGREED}) ag USING (doc_id)))""",
        "pages_", "engine", "features",
    ),
)
def intake_verdicts(spark, d):
    return it.intake_verdicts(_sources(spark, d), ev.page_evidence(spark, d), ev.engine_pages(spark, d), ev.document_features(spark, d))


@query(
    "markup_checks",
    with_(
        """SELECT doc_id, mark_no, reason IS NULL AS is_clear, reason FROM (SELECT m.doc_id, m.mark_no, CASE WHEN p.doc_id IS NULL OR (m.doc_id + m.page_index) % 31 = 0 OR a.mark_no IS NOT NULL THEN 'annotation-overlap' WHEN m.page_index % 5 = 4 THEN 'hidden-layer' END AS reason
        FROM marks m LEFT JOIN (SELECT doc_id, page_index FROM pages_ WHERE (doc_id + 5 * page_index) % 23 <> 0) p ON p.doc_id = m.doc_id AND p.page_index = m.page_index
        LEFT JOIN (SELECT DISTINCT m.doc_id, m.mark_no FROM marks m JOIN (SELECT doc_id, page_index, 36e0 + 54 * (doc_id % 8) AS x, 700e0 - 18 * (doc_id % 20) AS y FROM pages_ WHERE (doc_id + page_index) % 3 = 0) a ON a.doc_id = m.doc_id AND a.page_index = m.page_index
          AND least(m.x1, x + 50) - greatest(m.x0, x) > 0 AND least(m.y1, y + 18) - greatest(m.y0, y) > 0) a ON a.doc_id = m.doc_id AND a.mark_no = m.mark_no)""",
        "marks", "pages_",
    ),
)
def markup_checks(spark, d):
    return it.markup_verdicts(ev.marks(spark, d), ev.annotations(spark, d), ev.page_markup(spark, d))


@query(
    "transform_preconditions",
    with_(
        f"""SELECT doc_id, code IS NULL AS ok, code FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 0 OR d.doc_id % 19 = 0 THEN 'not-supported' WHEN {_FEATURE} IS NOT NULL THEN 'unsupported-feature'
          WHEN {_SOFT} <> '' AND d.doc_id % 4 <> 0 THEN 'unsupported-feature' WHEN coalesce(NOT r.valid, true) THEN 'no-valid-rectangle' WHEN d.doc_id % 26 = 0 THEN 'fingerprint-mismatch'
          WHEN d.n_chars * 1000 > 26214400 OR coalesce(p.n, 0) > 100 THEN 'over-limit' END AS code
          FROM documents d LEFT JOIN features f USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) p USING (doc_id)
          LEFT JOIN (SELECT doc_id, bool_and(a < c AND b < d AND abs(x0 - a) <= 0.02e0 AND abs(y0 - b) <= 0.02e0 AND abs(x1 - c) <= 0.02e0 AND abs(y1 - d) <= 0.02e0) AS valid FROM cut GROUP BY doc_id) r USING (doc_id))""",
        "features", "pages_", "cut",
    ),
)
def transform_preconditions(spark, d):
    """Two engines' verdicts, features, rectangles, fingerprints and budgets, in that order."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("byte_length"))
    rects = gq._back(gq._view(spark, d)).groupBy("doc_id").agg(F.bool_and(gq.round_trip_valid()).alias("valid"))
    pages = ev.page_evidence(spark, d)
    prints = pages.select("doc_id", "page_index", gq.geometry_fingerprint().alias("expected"))
    prints = prints.withColumn("actual", F.when(F.expr("doc_id % 26 = 0 and page_index = 0"), F.concat("expected", F.lit("0"))).otherwise(F.col("expected")))
    lists = prints.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "expected"))).alias("e"), F.array_sort(F.collect_list(F.struct("page_index", "actual"))).alias("a"), F.count("*").alias("page_count"))
    features = ev.document_features(spark, d).select("doc_id", pol.feature_reason().alias("feature"), (F.size(pol.soft_findings()) > 0).alias("soft"))
    all_ = docs.join(rects, "doc_id", "left").join(lists, "doc_id", "left").join(features, "doc_id", "left")
    equal = F.col("e").cast("array<struct<p:long,f:string>>") == F.col("a").cast("array<struct<p:long,f:string>>")
    code = (
        F.when(F.expr("doc_id % 17 = 0 or doc_id % 19 = 0"), "not-supported").when(F.col("feature").isNotNull(), "unsupported-feature")
        .when(F.coalesce("soft", F.lit(False)) & F.expr("doc_id % 4 <> 0"), "unsupported-feature").when(~F.coalesce("valid", F.lit(False)), "no-valid-rectangle")
        .when(~F.coalesce(equal, F.lit(False)), "fingerprint-mismatch")
        .when(pol.input_size(F.col("byte_length")).isNotNull() | pol.page_count(F.coalesce("page_count", F.lit(0))).isNotNull(), "over-limit")
    )
    return all_.select("doc_id", code.isNull().alias("ok"), code.alias("code"))


@query(
    "classifier_gates",
    with_(
        """SELECT doc_id, code, CASE code WHEN 'not-a-pdf' THEN 'wrong-type' WHEN 'encrypted' THEN 'locked' WHEN 'corrupt' THEN 'damaged' WHEN 'empty' THEN 'empty' WHEN 'over-limit' THEN 'over-limit' END AS reason
        FROM (SELECT f.doc_id, CASE WHEN f.doc_id % 43 = 0 THEN 'not-a-pdf' WHEN f.doc_id % 39 = 0 THEN 'corrupt' WHEN f.doc_id % 33 = 0 THEN 'encrypted' WHEN f.doc_id % 27 = 0 THEN 'corrupt'
          WHEN pc = 0 AND NOT (xfa OR signed OR form_widgets OR java_script_page OR rich_media OR embedded_files OR java_script_document) THEN 'empty' WHEN pc > 100 THEN 'over-limit' END AS code
          FROM (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 15 = 1 THEN 101 ELSE 1 + doc_id % 100 END AS pc FROM features) f)""",
        "features",
    ),
)
def classifier_gates(spark, d):
    """Magic, open, encryption, repair, pages and features, in that order; no pages but a feature still reports."""
    f = ev.document_features(spark, d)
    pages = F.when(F.expr("doc_id % 8 = 0"), 0).when(F.expr("doc_id % 15 = 1"), 101).otherwise(F.expr("1 + doc_id % 100"))
    code = (
        F.when(F.expr("doc_id % 43 = 0"), "not-a-pdf").when(F.expr("doc_id % 39 = 0"), "corrupt").when(F.expr("doc_id % 33 = 0"), "encrypted").when(F.expr("doc_id % 27 = 0"), "corrupt")
        .when((pages == 0) & ~pol.any_feature(), "empty").when(pol.page_count(pages).isNotNull(), "over-limit")
    )
    return f.withColumn("code", code).select("doc_id", "code", pol.lookup(pol.CLASSIFIER_REASONS, F.col("code")).alias("reason"))


_DICTS = """SELECT page_id AS doc_id, page_id % 47 = 0 AS bad, page_id % 2 = 0 AS info, page_id % 53 = 52 AS noroot, page_id % 3 = 0 AS metadata, page_id % 4 <> 3 AS names, page_id % 5 = 0 AS ef, page_id % 7 = 0 AS js, page_id % 11 = 0 AS oa, page_id % 13 = 0 AS aa FROM pages"""


@query(
    "sanitize_documents",
    f"""SELECT doc_id, error, CASE WHEN error IS NOT NULL AND info THEN 'dict' END AS info, CASE WHEN error IS NOT NULL AND metadata THEN CASE WHEN bad THEN 'dict' ELSE 'stream' END END AS metadata,
    CASE WHEN error IS NOT NULL AND oa THEN 'array' END AS open_action, CASE WHEN error IS NOT NULL AND aa THEN CASE WHEN bad THEN 'other' ELSE 'dict' END END AS aa,
    CASE WHEN (error IS NOT NULL OR NOT names) AND ef THEN CASE WHEN bad THEN 'other' ELSE 'dict' END END AS embedded_files, CASE WHEN (error IS NOT NULL OR NOT names) AND js THEN 'dict' END AS java_script, 'dict' AS dests
    FROM (SELECT *, CASE WHEN noroot THEN 'sanitize:no-root' WHEN metadata AND bad THEN 'sanitize:metadata-not-a-stream' WHEN names AND ef AND bad THEN 'sanitize:names-EmbeddedFiles-not-a-dictionary' WHEN aa AND bad THEN 'sanitize:aa-not-a-dictionary' END AS error FROM ({_DICTS}))""",
)
def sanitize_documents(spark, d):
    return it.sanitized(ev.dictionaries(spark, d))


@query("candidate_identity", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS byte_length, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS is_hex FROM documents")
def candidate_identity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", content_identity(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("byte_length"))
    return docs.withColumn("is_hex", F.col("sha256").rlike("^[0-9a-f]{64}$"))


@query(
    "latin1_round_trip",
    """SELECT doc_id, array_to_string(list_transform(range(1, length(chars) + 1), lambda i: printf('%02X', unicode(chars[i]))), '') = h AS is_equal, length(chars) = length(h) // 2 AS one_to_one
    FROM (SELECT doc_id, h, array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER))), '') AS chars FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))""",
)
def latin1_round_trip(spark, d):
    """Bytes to one character each and back; the bytes survive unchanged."""
    raw = F.col("text").cast("binary")
    decoded = F.decode(raw, "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", (F.encode(decoded, "ISO-8859-1") == raw).alias("is_equal"), (F.length(decoded) == F.octet_length("text")).alias("one_to_one"))


@query(
    "self_check",
    with_(
        """SELECT doc_id, source_pages, candidate_pages, CASE WHEN candidate_pages > 0 AND candidate_pages = source_pages AND doc_id % 38 <> 0 THEN 'ok' ELSE 'failed' END AS status
        FROM (SELECT doc_id, page_count AS source_pages, greatest(0, page_count - CASE WHEN doc_id % 10 = 6 THEN 1 ELSE 0 END) AS candidate_pages FROM counted)""",
        "counted",
    ),
)
def self_check(spark, d):
    """The candidate reopens, has the source's pages and its first page renders; documents without pages fail."""
    source = table(spark, d, "documents").select("doc_id").join(ev.page_evidence(spark, d).groupBy("doc_id").agg(F.count("*").alias("source_pages")), "doc_id", "left")
    source = source.withColumn("source_pages", F.coalesce("source_pages", F.lit(0)).cast("long"))
    out = source.withColumn("candidate_pages", F.greatest(F.lit(0), F.col("source_pages") - F.when(F.expr("doc_id % 10 = 6"), 1).otherwise(0)).cast("long"))
    ok = (F.col("candidate_pages") > 0) & (F.col("candidate_pages") == F.col("source_pages")) & F.expr("doc_id % 38 <> 0")
    return out.withColumn("status", F.when(ok, "ok").otherwise("failed"))


@query("evidence_constants", " UNION ALL ".join(f"SELECT '{k}' AS name, '{v}' AS value" for k, v in {**pol.VERSIONS, **pol.VISUAL_THRESHOLDS}.items()))
def evidence_constants(spark, d):
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in {**pol.VERSIONS, **pol.VISUAL_THRESHOLDS}.items()])
    return spark.range(1).select(F.inline(rows))
