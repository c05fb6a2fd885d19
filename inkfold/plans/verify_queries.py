"""Queries over rasters, document checks, reports and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import policy as pol
from inkfold.functions.predicates import within
from inkfold.operators import protocol as pr
from inkfold.operators import textchecks as tc
from inkfold.operators import verification as ver
from inkfold.operators import visual as vis
from inkfold.plans import text_queries as tq
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev
from inkfold.sources.sinks import canonical_bytes, canonical_json
from inkfold.sources.tables import table

_INNER, _ZONE = (8, 8, 24, 24), (4, 4, 28, 28)
_FILL = """SELECT r, CASE WHEN reason_code = 'verify.visual.fill-ok' THEN 'pass' ELSE 'fail' END AS outcome, reason_code FROM (SELECT r, CASE WHEN max(cand) - min(cand) > 4 THEN 'verify.visual.non-uniform-fill'
  WHEN (max(cand) + min(cand)) / 2e0 > 8 THEN 'verify.visual.unexpected-fill' WHEN bool_or(abs(cand - src) <= 4 AND src > 8) THEN 'verify.visual.retained-pixels' ELSE 'verify.visual.fill-ok' END AS reason_code
  FROM pixels WHERE x >= 8 AND x < 24 AND y >= 8 AND y < 24 GROUP BY r)"""
_ALL_FILLS = f"""SELECT n.r, CASE WHEN n.pixels <> 1024 THEN 'indeterminate' ELSE f.outcome END AS outcome, CASE WHEN n.pixels <> 1024 THEN 'verify.visual.render-unavailable' ELSE f.reason_code END AS reason_code
  FROM (SELECT r, count(*) AS pixels FROM pixels GROUP BY r) n LEFT JOIN ({_FILL}) f USING (r)"""
_RASTER = "doc_id % (SELECT max(vec_id) // 16 + 1 FROM embeddings)"
_DAMAGE = "SELECT r, bool_or(NOT (x >= 4 AND x < 28 AND y >= 4 AND y < 28) AND abs(cand - src) > 2) AS damaged FROM pixels GROUP BY r"


@query("fill_checks", with_(_ALL_FILLS, "pixels"))
def fill_checks(spark, d):
    """Every raster; one that lacks pixels is indeterminate."""
    return vis.fill_verdicts(ev.raster_pixels(spark, d), _INNER, 1024)


def _raster(spark: SparkSession, d: str) -> Column:
    """The raster of a document: its id modulo the number of rasters, so each raster has its share of the documents."""
    return F.col("doc_id") % table(spark, d, "embeddings").select(F.expr("max(vec_id) div 16 + 1")).scalar()


@query("retained_pixels", with_("SELECT r, CAST(count(*) FILTER (WHERE abs(cand - src) <= 4 AND src > 8) AS BIGINT) AS retained FROM pixels WHERE x >= 8 AND x < 24 AND y >= 8 AND y < 24 GROUP BY r", "pixels"))
def retained_pixels(spark, d):
    px = ev.raster_pixels(spark, d).where("x >= 8 and x < 24 and y >= 8 and y < 24")
    return px.groupBy("r").agg(F.count_if(within(F.col("cand"), F.col("src"), vis.RETAINED) & (F.col("src") > vis.FILL_BLACK)).alias("retained"))


@query("outside_mask", with_(f"SELECT r, damaged, CASE WHEN damaged THEN 'verify.visual.outside-damage' ELSE 'verify.visual.outside-ok' END AS reason_code FROM ({_DAMAGE})", "pixels"))
def outside_mask(spark, d):
    out = vis.outside_damage(ev.raster_pixels(spark, d), _ZONE)
    return out.withColumn("reason_code", F.when(F.col("damaged"), "verify.visual.outside-damage").otherwise("verify.visual.outside-ok"))


@query("pixel_diff", with_("SELECT r, CAST(count(*) FILTER (WHERE abs(cand - src) > 2) AS BIGINT) AS differing FROM pixels GROUP BY r", "pixels"))
def pixel_diff(spark, d):
    """The same rasters as binary rows, compared without exploding them."""
    joined = lambda c: F.expr(f"unhex(array_join(transform(array_sort(collect_list(struct(y, x, lpad(hex({c}), 2, '0') AS h))), z -> z.h), ''))")
    return vis.raster_differences(ev.raster_pixels(spark, d).groupBy("r").agg(joined("src").alias("src"), joined("cand").alias("cand")))


def _requested(spark: SparkSession, d: str) -> DataFrame:
    return ev.marks(spark, d).select("doc_id").distinct()


def _candidate_pages(pages: DataFrame) -> DataFrame:
    """Dropped last pages, a drifted view and a turned page are planted by remainders."""
    kept = pages.where("not (doc_id % 10 = 6 and page_index = page_count - 1)")
    return kept.withColumn("cx1", F.col("cx1") - F.when(F.expr("doc_id % 10 = 8 and page_index = 0"), 1.0).otherwise(0.0)).withColumn("rotation", F.col("rotation") + F.when(F.expr("doc_id % 14 = 0"), 90).otherwise(360))


def _document_checks(spark: SparkSession, d: str) -> DataFrame:
    pages = ev.page_evidence(spark, d)
    return ver.document_checks(_requested(spark, d), pages, _candidate_pages(pages), ev.feature_names(spark, d))


_REQ = "SELECT DISTINCT doc_id FROM marks"
_DOCCHECKS = """SELECT doc_id, 'document.page-count' AS check_, -1 AS page, CASE WHEN doc_id % 10 = 6 THEN 'fail' ELSE 'pass' END AS outcome, 'verify.document.page-count.' || CASE WHEN doc_id % 10 = 6 THEN 'mismatch' ELSE 'ok' END AS reason_code, 0 AS ord FROM req
  UNION ALL SELECT doc_id, 'document.page-view', page_index, CASE WHEN v = 'ok' THEN 'pass' ELSE 'fail' END, 'verify.document.page-view.' || v, 1 + 2 * page_index FROM (SELECT *, CASE WHEN doc_id % 10 = 6 AND page_index = page_count - 1 THEN 'missing' WHEN doc_id % 10 = 8 AND page_index = 0 THEN 'mismatch' ELSE 'ok' END AS v FROM pages_ SEMI JOIN req USING (doc_id))
  UNION ALL SELECT doc_id, 'document.page-rotation', page_index, CASE WHEN doc_id % 14 = 0 THEN 'fail' ELSE 'pass' END, 'verify.document.page-rotation.' || CASE WHEN doc_id % 14 = 0 THEN 'mismatch' ELSE 'ok' END, 2 + 2 * page_index FROM pages_ SEMI JOIN req USING (doc_id) WHERE NOT (doc_id % 10 = 6 AND page_index = page_count - 1)
  UNION ALL SELECT r.doc_id, 'document.' || family, -1, CASE WHEN x.doc_id IS NULL THEN 'pass' ELSE 'fail' END, 'verify.document.' || family || CASE WHEN x.doc_id IS NULL THEN '.ok' ELSE '.introduced' END, CASE family WHEN 'js-actions' THEN 1000000 WHEN 'attachments' THEN 1000001 ELSE 1000002 END
    FROM (SELECT doc_id, unnest(['js-actions', 'attachments', 'fields']) AS family FROM req) r LEFT JOIN (SELECT DISTINCT doc_id, family FROM names a WHERE side = 'candidate' AND NOT EXISTS (SELECT 1 FROM names b WHERE b.side = 'source' AND a.doc_id = b.doc_id AND a.family = b.family AND a.name = b.name)) x USING (doc_id, family)"""


@query("document_checks", with_('SELECT doc_id, check_ AS "check", CAST(page AS BIGINT) AS page, outcome, reason_code FROM dchecks', "marks", "pages_", "names", req=_REQ, dchecks=_DOCCHECKS))
def document_checks(spark, d):
    return _document_checks(spark, d).drop("ord")


@query("introduced_names", with_("SELECT doc_id, family, name FROM names WHERE side = 'candidate' EXCEPT SELECT doc_id, family, name FROM names WHERE side = 'source'", "names"))
def introduced_names(spark, d):
    return ver.introduced(ev.feature_names(spark, d))


def _selection_checks(spark: SparkSession, d: str) -> DataFrame:
    """Both aspects of every mark, and whether its text occurs elsewhere; documents with remainder 2 of 50 lack both
    aspects (the text's outcome is null), with 12 the visual one."""
    known = lambda c: F.when(F.expr("doc_id % 50 <> 2"), F.col(c)).alias(c)
    text = tc.text_checks(tq.checked(spark, d)).select("doc_id", "mark_no", F.lit("text").alias("aspect"), known("outcome"), known("reason_code"), F.col("duplicate").isNotNull().alias("warned"))
    fills = fill_checks(spark, d)
    shown = ev.marks(spark, d).where("doc_id % 50 not in (2, 12)").withColumn("r", _raster(spark, d)).join(fills, "r")
    return text.unionByName(shown.select("doc_id", "mark_no", F.lit("visual").alias("aspect"), "outcome", "reason_code", F.lit(False).alias("warned")))


_SELCHECKS = f"""SELECT doc_id, mark_no, 'text' AS aspect, outcome, reason_code FROM ({tq._CHECKS}) WHERE doc_id % 50 <> 2
  UNION ALL SELECT m.doc_id, m.mark_no, 'visual', f.outcome, f.reason_code FROM marks m JOIN ({_ALL_FILLS}) f ON f.r = m.{_RASTER} WHERE m.doc_id % 50 NOT IN (2, 12)"""
_SELECTIONS = """SELECT m.doc_id, m.mark_no, m.page_index, t.reason_code AS text_code, v.reason_code AS visual_code,
  CASE WHEN t.outcome IS NULL OR v.outcome IS NULL THEN 'indeterminate' WHEN 'fail' IN (t.outcome, v.outcome) THEN 'fail' WHEN 'indeterminate' IN (t.outcome, v.outcome) THEN 'indeterminate' ELSE 'pass' END AS outcome,
  CASE WHEN t.outcome IS NULL AND v.outcome IS NULL THEN 'verify.report.selection-missing' WHEN t.outcome IS NULL OR v.outcome IS NULL THEN 'verify.report.aspect-missing' WHEN t.outcome = 'fail' THEN t.reason_code
    WHEN v.outcome = 'fail' THEN v.reason_code WHEN t.outcome = 'indeterminate' THEN t.reason_code WHEN v.outcome = 'indeterminate' THEN v.reason_code ELSE t.reason_code END AS reason_code
  FROM marks m LEFT JOIN (SELECT * FROM selchecks WHERE aspect = 'text') t USING (doc_id, mark_no) LEFT JOIN (SELECT * FROM selchecks WHERE aspect = 'visual') v USING (doc_id, mark_no)"""


@query("assembled_selections", with_("SELECT doc_id, mark_no, page_index, outcome, reason_code FROM sel", "marks", "cand", "pixels", selchecks=_SELCHECKS, sel=_SELECTIONS))
def assembled_selections(spark, d):
    return ver.assembled_selections(ev.marks(spark, d), _selection_checks(spark, d)).drop("text_code", "visual_code", "warned")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    marks = ev.marks(spark, d)
    docs = _requested(spark, d)
    damage = vis.outside_damage(ev.raster_pixels(spark, d), _ZONE, 1024)
    pages = docs.withColumn("r", _raster(spark, d)).join(damage, "r", "left")
    worst = F.when(F.col("damaged").isNull(), "indeterminate").when(F.col("damaged"), "fail").otherwise("pass")
    why = F.when(F.col("damaged").isNull(), "verify.visual.render-unavailable").when(F.col("damaged"), "verify.visual.outside-damage").otherwise("verify.visual.outside-ok")
    outside = ver.outside_fold(pages.select("doc_id", F.lit(0).alias("ord"), worst.alias("outcome"), why.alias("reason_code")))
    selections = ver.assembled_selections(marks, _selection_checks(spark, d))
    return ver.reports(docs, _document_checks(spark, d), selections, outside)


_OUT = f"""SELECT doc_id, CASE WHEN damaged IS NULL THEN 'indeterminate' WHEN damaged THEN 'fail' ELSE 'pass' END AS outcome, 'verify.visual.' || CASE WHEN damaged IS NULL THEN 'render-unavailable' WHEN damaged THEN 'outside-damage' ELSE 'outside-ok' END AS reason_code
  FROM (SELECT r.doc_id, g.damaged FROM req r LEFT JOIN (SELECT * FROM ({_DAMAGE}) JOIN (SELECT r FROM pixels GROUP BY r HAVING count(*) = 1024) USING (r)) g ON g.r = r.{_RASTER})"""
_REPORT = """SELECT r.doc_id, CASE WHEN bool_or(o.outcome = 'fail') THEN 'fail' WHEN bool_or(o.outcome = 'indeterminate') THEN 'indeterminate' ELSE 'pass' END AS outcome, any_value(c.reason_codes) AS reason_codes, any_value(s.n) AS rect_count, coalesce(any_value(w.n), 0) AS warnings
  FROM req r JOIN (SELECT doc_id, outcome FROM dchecks UNION ALL SELECT doc_id, outcome FROM sel UNION ALL SELECT doc_id, outcome FROM outside) o USING (doc_id)
  JOIN (SELECT doc_id, string_agg(reason_code, ',' ORDER BY part, ord) AS reason_codes FROM (SELECT doc_id, reason_code, part, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, reason_code ORDER BY part, ord) AS k FROM (
      SELECT doc_id, 0 AS part, ord, reason_code FROM dchecks UNION ALL SELECT doc_id, 1, mark_no * 3, text_code FROM sel WHERE text_code IS NOT NULL UNION ALL SELECT doc_id, 1, mark_no * 3 + 1, visual_code FROM sel WHERE visual_code IS NOT NULL
      UNION ALL SELECT doc_id, 1, mark_no * 3 + 2, reason_code FROM sel WHERE text_code IS NULL OR visual_code IS NULL UNION ALL SELECT doc_id, 2, 0, reason_code FROM outside)) WHERE k = 1) GROUP BY doc_id) c USING (doc_id)
  JOIN (SELECT doc_id, count(*) AS n FROM marks GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM warned GROUP BY doc_id) w USING (doc_id) GROUP BY r.doc_id"""
_WARNED = f"SELECT v.doc_id, v.mark_no, min(p.page_index) AS page_index FROM ({tq._SELECTED}) v JOIN ({tq._PAGE_TEXT}) p ON p.doc_id = v.doc_id AND contains(p.value, v.value) WHERE v.value <> '' GROUP BY v.doc_id, v.mark_no"
_PARTS = dict(req=_REQ, dchecks=_DOCCHECKS, selchecks=_SELCHECKS, sel=_SELECTIONS, outside=_OUT, warned=_WARNED, report=_REPORT)
_NEEDS = ("marks", "cand", "pixels", "pages_", "names")


@query("verification_reports", with_("SELECT doc_id, outcome, reason_codes, rect_count, warnings FROM report", *_NEEDS, **_PARTS))
def verification_reports(spark, d):
    return _reports(spark, d)


@query(
    "canonical_report_json",
    with_(
        """SELECT doc_id, j AS json, sha256(j) AS sha256 FROM (SELECT doc_id, CAST(json_object('docId', doc_id, 'engineVersion', 'mupdf/1.28.1', 'outcome', outcome, 'pdfjsVersion', '6.3.289', 'policyVersion', 'verify-policy/1',
        'reasonCodes', string_split(reason_codes, ','), 'rectCount', rect_count) AS VARCHAR) AS j FROM report)""",
        *_NEEDS, **_PARTS,
    ),
)
def canonical_report_json(spark, d):
    engine = F.regexp_replace(F.lit(pol.VERSIONS["verifyEngine"]), "^pdfjs/", "")
    json = canonical_json(
        outcome=F.col("outcome"), docId=F.col("doc_id"), rectCount=F.col("rect_count"), reasonCodes=F.split("reason_codes", ","), engineVersion=F.lit(pol.VERSIONS["transformEngine"]),
        policyVersion=F.lit(pol.VERSIONS["verifyPolicy"]), pdfjsVersion=engine, candidateSha256=F.lit(None).cast("string"),
    )
    return _reports(spark, d).select("doc_id", json.alias("json")).withColumn("sha256", F.sha2(canonical_bytes(F.col("json")), 256))


@query(
    "all_checks",
    with_(
        """SELECT doc_id, family, outcome, count(*) AS n FROM (SELECT doc_id, 'document' AS family, outcome FROM dchecks UNION ALL SELECT doc_id, aspect, outcome FROM selchecks
        UNION ALL SELECT doc_id, 'outside', outcome FROM outside UNION ALL SELECT doc_id, 'warning', 'advisory' FROM warned) GROUP BY ALL""",
        *_NEEDS, **_PARTS,
    ),
)
def all_checks(spark, d):
    """Every check family side by side, counted by document and outcome."""
    damage = vis.outside_damage(ev.raster_pixels(spark, d), _ZONE, 1024)
    outside = _requested(spark, d).withColumn("r", _raster(spark, d)).join(damage, "r", "left")
    checks = _selection_checks(spark, d)
    union = (
        _document_checks(spark, d).select("doc_id", F.lit("document").alias("family"), "outcome")
        .unionByName(checks.where("outcome is not null").select("doc_id", F.col("aspect").alias("family"), "outcome"))
        .unionByName(outside.select("doc_id", F.lit("outside").alias("family"), F.when(F.col("damaged").isNull(), "indeterminate").when(F.col("damaged"), "fail").otherwise("pass").alias("outcome")))
        .unionByName(checks.where("warned").select("doc_id", F.lit("warning").alias("family"), F.lit("advisory").alias("outcome")))
    )
    return union.groupBy("doc_id", "family", "outcome").agg(F.count("*").alias("n"))


def valid_message():
    """A request that its handler would accept, by type."""
    sound = ~F.col("broken") & F.col("page").isNotNull()
    scale = F.col("scale").between(0.05, 16.0) & ~F.isnan("scale")
    return (
        F.when(F.col("type") == "OPEN_SOURCE", F.lit(True)).when(F.col("type") == "RENDER_PAGE", sound & (F.col("page") >= 1) & (F.col("page") <= 10) & scale)
        .when(F.col("type") == "EXTRACT_TEXT_PAGE", sound & (F.col("page") >= 1) & (F.col("page") <= 10)).when(F.col("type").isin("APPLY_REDACTIONS", "VERIFY_CANDIDATE"), sound).otherwise(F.lit(False))
    )


_VALID = """CASE WHEN type = 'OPEN_SOURCE' THEN true WHEN type = 'RENDER_PAGE' THEN coalesce(NOT broken AND page BETWEEN 1 AND 10 AND scale BETWEEN 0.05 AND 16, false)
  WHEN type = 'EXTRACT_TEXT_PAGE' THEN coalesce(NOT broken AND page BETWEEN 1 AND 10, false) WHEN type IN ('APPLY_REDACTIONS', 'VERIFY_CANDIDATE') THEN NOT broken ELSE false END"""


@query("protocol_validation", with_(f"SELECT request_id, type, {_VALID} AS is_valid, CASE WHEN {_VALID} THEN 'accepted' WHEN type = 'FIND_PAGE' THEN 'unexpected' ELSE 'invalid_request' END AS verdict FROM msgs", "msgs"))
def protocol_validation(spark, d):
    out = ev.messages(spark, d).withColumn("is_valid", F.coalesce(valid_message(), F.lit(False)))
    return out.select("request_id", "type", "is_valid", F.when(F.col("is_valid"), "accepted").when(F.col("type") == "FIND_PAGE", "unexpected").otherwise("invalid_request").alias("verdict"))


@query(
    "latest_render_requests",
    with_(f"SELECT session, max(request_id) AS request_id, arg_max({_VALID}, request_id) AS is_valid, count(*) - 1 AS superseded FROM msgs WHERE type = 'RENDER_PAGE' GROUP BY session", "msgs"),
)
def latest_render_requests(spark, d):
    asked = ev.messages(spark, d).where("type = 'RENDER_PAGE'")
    newest = ver.latest(asked, "session", "request_id").select("session", "request_id", F.coalesce(valid_message(), F.lit(False)).alias("is_valid"))
    return newest.join(asked.groupBy("session").agg((F.count("*") - 1).alias("superseded")), "session")


@query(
    "transform_dispatch",
    with_(
        """SELECT request_id, status, CASE WHEN status = 'CANDIDATE_READY' THEN sha256(payload) END AS sha256, CASE WHEN status = 'CANDIDATE_READY' THEN octet_length(encode(payload))::DOUBLE END AS byte_length
        FROM (SELECT request_id, props AS payload, CASE WHEN request_id % 9 = 0 THEN 'invalid-request' WHEN request_id % 35 = 3 THEN 'engine-error' WHEN request_id % 28 = 3 THEN 'self-check-failed' ELSE 'CANDIDATE_READY' END AS status
        FROM msgs JOIN events ON event_id = request_id WHERE type = 'APPLY_REDACTIONS')""",
        "msgs",
    ),
)
def transform_dispatch(spark, d):
    """Validate, apply, self-check, then identify the candidate."""
    props = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "props")
    asked = ev.messages(spark, d).where("type = 'APPLY_REDACTIONS'").join(props, "request_id")
    status = F.when(F.col("broken"), "invalid-request").when(F.expr("request_id % 35 = 3"), "engine-error").when(F.expr("request_id % 28 = 3"), "self-check-failed").otherwise("CANDIDATE_READY")
    ready = F.col("status") == "CANDIDATE_READY"
    return asked.withColumn("status", status).select("request_id", "status", F.when(ready, F.sha2("props", 256)).alias("sha256"), F.when(ready, F.octet_length("props").cast("double")).alias("byte_length"))


@query(
    "verify_dispatch",
    with_(
        """SELECT request_id, status, CASE status WHEN 'VERIFY_RESULT' THEN 'pass' WHEN 'digest-mismatch' THEN 'fail' WHEN 'parse-error' THEN 'fail' ELSE 'indeterminate' END AS outcome
        FROM (SELECT request_id, CASE WHEN broken THEN 'protocol' WHEN request_id % 50 = 4 THEN 'budget-exhausted' WHEN request_id % 16 = 4 THEN 'digest-mismatch' WHEN request_id % 22 = 4 THEN 'parse-error' WHEN request_id % 26 = 4 THEN 'source-unavailable' ELSE 'VERIFY_RESULT' END AS status
        FROM msgs WHERE type = 'VERIFY_CANDIDATE')""",
        "msgs",
    ),
)
def verify_dispatch(spark, d):
    """Protocol, size cap, digest before opening, candidate, source, checks."""
    props = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "props")
    asked = ev.messages(spark, d).where("type = 'VERIFY_CANDIDATE'").join(props, "request_id")
    size = F.when(F.expr("request_id % 50 = 4"), 70_000_000).otherwise(F.octet_length("props"))
    expected = F.when(F.expr("request_id % 16 = 4"), F.sha2(F.concat("props", F.lit("x")), 256)).otherwise(F.sha2("props", 256))
    status = (
        F.when(F.col("broken"), "protocol").when(size > pol.MAX_CANDIDATE_BYTES, "budget-exhausted").when(F.sha2("props", 256) != expected, "digest-mismatch")
        .when(F.expr("request_id % 22 = 4"), "parse-error").when(F.expr("request_id % 26 = 4"), "source-unavailable").otherwise("VERIFY_RESULT")
    )
    return asked.withColumn("status", status).select("request_id", "status", F.coalesce(pol.lookup(pol.VERIFY_OUTCOMES, F.col("status")), F.lit("pass")).alias("outcome"))


_GUARD = """CASE type WHEN 'OPEN_SOURCE' THEN true WHEN 'APPLY_REDACTIONS' THEN payload_bytes IS NOT NULL AND coalesce(rects, 0) > 0 AND NOT bad_shape AND NOT (old_transform OR old_redaction OR old_save) AND k % 5 <> 4
  WHEN 'CANDIDATE_READY' THEN payload_bytes IS NOT NULL AND coalesce(regexp_full_match(digest, '[0-9a-f]{64}'), false) AND byte_length = payload_bytes AND k % 10 <> 9 AND NOT (old_transform OR old_redaction OR old_save)
  WHEN 'TRANSFORM_FAILED' THEN reason IS NOT NULL WHEN 'VERIFY_FAILED' THEN coalesce(reason IN ('timeout', 'digest-mismatch'), false) WHEN 'VERIFY_RESULT' THEN k % 8 <> 7 WHEN 'VERIFY_CHECKPOINT' THEN k % 4 < 2
  WHEN 'VERIFY_CANDIDATE' THEN payload_bytes IS NOT NULL AND source_bytes IS NOT NULL AND digest IS NOT NULL AND rects IS NOT NULL AND (rects = 0 OR NOT lacks_field) AND NOT bad_page AND NOT (old_verify OR old_policy) ELSE false END"""


@query("message_guards", with_(f"SELECT request_id, type, {_GUARD} AS is_valid FROM workmsgs", "workmsgs"))
def message_guards(spark, d):
    """Field by field, whether each message is one that its receiver would take."""
    return pr.guarded(ev.worker_messages(spark, d)).select("request_id", "type", "is_valid")


@query(
    "transform_answers",
    with_(
        f"""SELECT request_id, status, CASE WHEN status = 'CANDIDATE_READY' THEN sha256(props) END AS sha256, CASE WHEN status = 'CANDIDATE_READY' THEN octet_length(encode(props))::DOUBLE END AS byte_length
        FROM (SELECT *, CASE WHEN NOT is_valid THEN 'invalid-request' WHEN props LIKE '%7%' THEN 'engine-error' WHEN k % 12 IN (5, 7) OR k % 8 = 5 THEN 'self-check-failed' ELSE 'CANDIDATE_READY' END AS status
          FROM (SELECT request_id, props, k, {_GUARD} AS is_valid FROM workmsgs WHERE type = 'APPLY_REDACTIONS'))""",
        "workmsgs",
    ),
)
def transform_answers(spark, d):
    """What each request to redact is answered: the engine fails on some payloads, some candidates lose pages or do not render."""
    asked = pr.guarded(ev.worker_messages(spark, d).where("type = 'APPLY_REDACTIONS'"))
    asked = asked.withColumns({
        "candidate": F.when(~F.col("props").contains("7"), F.col("props")), "source_pages": 1 + F.col("k") % 4,
        "candidate_pages": F.when(F.expr("k % 12 = 5"), F.col("k") % 4).when(F.expr("k % 12 <> 7"), 1 + F.col("k") % 4), "renders": F.expr("k % 8 <> 5"),
    })
    return pr.transform_answers(asked)


@query(
    "verify_answers",
    with_(
        f"""SELECT request_id, status, CASE WHEN status = 'VERIFY_RESULT' THEN 'pass' WHEN status IN ('digest-mismatch', 'parse-error') THEN 'fail' ELSE 'indeterminate' END AS outcome
        FROM (SELECT request_id, CASE WHEN NOT is_valid THEN 'protocol' WHEN octet_length(encode(props)) * (1 + k % 9) * 1000000 > 67108864 THEN 'budget-exhausted' WHEN digest IS NULL OR sha256(props) <> digest THEN 'digest-mismatch'
          WHEN k % 7 = 3 THEN 'parse-error' WHEN k % 5 = 1 THEN 'source-unavailable' ELSE 'VERIFY_RESULT' END AS status FROM (SELECT *, {_GUARD} AS is_valid FROM workmsgs WHERE type = 'VERIFY_CANDIDATE'))""",
        "workmsgs",
    ),
)
def verify_answers(spark, d):
    """What each request to verify is answered, gate by gate; sizes are planted in millions of bytes."""
    asked = pr.guarded(ev.worker_messages(spark, d).where("type = 'VERIFY_CANDIDATE'"))
    asked = asked.withColumns({
        "candidate": F.col("props"), "candidate_size": F.octet_length("props").cast("long") * (1 + F.col("k") % 9) * 1_000_000, "expected_sha256": F.col("sha256"),
        "candidate_opens": F.expr("k % 7 <> 3"), "source_opens": F.expr("k % 5 <> 1"),
    })
    return pr.verify_answers(asked)
