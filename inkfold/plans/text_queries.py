"""Queries over text items and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions import text as tx
from inkfold.operators import textchecks as tc
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev
from inkfold.sources.tables import settled, table


def checked(spark: SparkSession, d: str) -> DataFrame:
    """The text evidence of every document; those with id mod 10 = 4 are painted over only and keep all text."""
    return tc.checked(ev.marked_pages(spark, d), F.col("doc_id") % 10 == 4)


@query("text_item_boxes", with_("SELECT doc_id, ord, page_index, x0, y0, x1, y1 FROM boxed", "boxed"))
def text_item_boxes(spark, d):
    b = ev.boxed_items(ev.text_items(spark, d))
    return b.select("doc_id", "ord", "page_index", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "text_item_boxes_rotated",
    with_(
        """SELECT doc_id, ord, 'rotated' AS layout, x - 10 AS x0, y AS y0, x + 3 AS x1, y + w AS y1 FROM placed
        UNION ALL SELECT doc_id, ord, 'mirrored', x - w, y - 3, x, y + 10 FROM placed""",
        "placed",
    ),
)
def text_item_boxes_rotated(spark, d):
    def one(layout: str) -> DataFrame:
        b = ev.boxed_items(ev.text_items(spark, d, layout))
        return b.select("doc_id", "ord", F.lit(layout).alias("layout"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])

    return one("rotated").unionByName(one("mirrored"))


@query(
    "normalized_text_values",
    r"""SELECT doc_id, md5(v) AS value_md5, CAST(length(v) AS BIGINT) AS value_length, v <> '' AS is_visible FROM (
    SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '\p{Cf}', '', 'g'), '[\s\p{Z}\x0B\x85]+', ' ', 'g')) AS v FROM documents)""",
)
def normalized_text_values(spark, d):
    out = tx.normalized_values(table(spark, d, "documents").select("doc_id", "text"), "text", "v")
    return out.select("doc_id", F.md5(F.col("v").cast("binary")).alias("value_md5"), F.length("v").cast("long").alias("value_length"), (F.col("v") != "").alias("is_visible"))


_CHECKS = """SELECT m.doc_id, m.mark_no, m.page_index, CASE WHEN h.mark_no IS NULL THEN 'pass' ELSE 'fail' END AS outcome,
  CASE WHEN h.mark_no IS NULL THEN 'verify.text.clear' ELSE 'verify.text.remaining-text' END AS reason_code
  FROM marks m LEFT JOIN (SELECT DISTINCT m.doc_id, m.mark_no FROM marks m JOIN cand c ON c.doc_id = m.doc_id AND c.page_index = m.page_index
    AND c.x0 <= m.x1 AND m.x0 <= c.x1 AND c.y0 <= m.y1 AND m.y0 <= c.y1) h ON h.doc_id = m.doc_id AND h.mark_no = m.mark_no"""


@query("verify_text_checks", with_(_CHECKS, "marks", "cand"))
def verify_text_checks(spark, d):
    return tc.text_checks(checked(spark, d)).drop("duplicate")


_SELECTED = """SELECT m.doc_id, m.mark_no, coalesce(string_agg(b.str, ' ' ORDER BY b.ord), '') AS value FROM marks m LEFT JOIN boxed b ON b.doc_id = m.doc_id
  AND b.page_index = m.page_index AND b.x0 <= m.x1 AND m.x0 <= b.x1 AND b.y0 <= m.y1 AND m.y0 <= b.y1 GROUP BY m.doc_id, m.mark_no"""
_PAGE_TEXT = """SELECT c.doc_id, c.page_index, string_agg(c.str, ' ' ORDER BY c.ord) AS value FROM cand c LEFT JOIN hits h ON c.doc_id = h.doc_id AND c.ord = h.ord
  WHERE h.ord IS NULL GROUP BY c.doc_id, c.page_index"""


@query("selected_values", with_(_SELECTED, "marks", "boxed"))
def selected_values(spark, d):
    return tc.selections(checked(spark, d)).select("doc_id", "mark_no", "value")


@query("unmarked_page_text", with_(f"SELECT doc_id, page_index, md5(value) AS text_md5, CAST(length(value) AS BIGINT) AS text_length FROM ({_PAGE_TEXT})", "cand"))
def unmarked_page_text(spark, d):
    out = tc.page_text(checked(spark, d))
    return out.select("doc_id", "page_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("text_length"))


@query(
    "duplicate_warnings",
    with_(
        """SELECT v.doc_id, v.mark_no, min(p.page_index) AS page_index, 'duplicate-occurrence' AS code FROM vals v JOIN ptext p ON p.doc_id = v.doc_id AND contains(p.value, v.value)
        WHERE v.value <> '' GROUP BY v.doc_id, v.mark_no""",
        "cand", "marks", vals=_SELECTED, ptext=_PAGE_TEXT,
    ),
)
def duplicate_warnings(spark, d):
    return tc.duplicate_warnings(checked(spark, d)).withColumn("code", F.lit("duplicate-occurrence")).orderBy("doc_id", "mark_no")


@query(
    "apply_text_redaction",
    with_(
        """SELECT b.doc_id, count(*) AS items_before, CAST(sum(CASE WHEN h.ord IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS items_removed,
        md5(coalesce(string_agg(b.str, ' ' ORDER BY b.ord) FILTER (WHERE h.ord IS NULL), '')) AS kept_md5
        FROM boxed b LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.ord = b.ord GROUP BY b.doc_id""",
        "boxed", "hits",
    ),
)
def apply_text_redaction(spark, d):
    return tc.kept_text(ev.marked_pages(spark, d)).select("doc_id", "items_before", "items_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query(
    "page_text_presence",
    with_("SELECT doc_id, page_index, bool_or(trim(str) <> '' OR ord % 10 = 9) AS has_text, count(*) AS operators, CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sound_items FROM placed GROUP BY doc_id, page_index", "placed"),
)
def page_text_presence(spark, d):
    items = ev.text_items(spark, d).withColumn("has_eol", F.col("ord") % 10 == 9)
    sound = (F.size("transform") == 6) & F.forall("transform", lambda x: x.isNotNull()) & (F.coalesce("width", F.lit(0.0)) > 0)
    return items.groupBy("doc_id", "page_index").agg(
        F.bool_or((F.trim("str") != "") | F.col("has_eol")).alias("has_text"), F.count("*").alias("operators"), F.sum(sound.cast("long")).alias("sound_items"),
    )


@query(
    "removed_glyph_zones",
    with_(
        """SELECT doc_id, page_index, kind, ord, greatest(0, floor(2 * x0) - m) :: BIGINT AS zx0, greatest(0, floor(2 * (792 - y1)) - m) :: BIGINT AS zy0,
        least(1224, ceil(2 * x1) + m) :: BIGINT AS zx1, least(1584, ceil(2 * (792 - y0)) + m) :: BIGINT AS zy1
        FROM (SELECT doc_id, page_index, 'mask' AS kind, mark_no AS ord, x0, y0, x1, y1, 2 AS m FROM marks
          UNION ALL SELECT b.doc_id, b.page_index, 'glyph', b.ord, b.x0, b.y0, b.x1, b.y1, 3 FROM boxed b JOIN hits h ON h.doc_id = b.doc_id AND h.ord = b.ord)""",
        "marks", "boxed", "hits",
    ),
)
def removed_glyph_zones(spark, d):
    kind = lambda name, ord_: (F.lit(name).alias("kind"), F.col(ord_).alias("ord"))
    masks = ev.marks(spark, d).select("doc_id", "page_index", *kind("mask", "mark_no"), "x0", "y0", "x1", "y1")
    glyphs = tc.removed(ev.marked_pages(spark, d)).select("doc_id", "page_index", *kind("glyph", "ord"), "x0", "y0", "x1", "y1")
    page = tuple(F.lit(float(v)) for v in (0, 0, 612, 792))
    width, height = F.lit(1224), F.lit(1584)
    both = settled(masks.unionByName(glyphs), "v", g.to_viewport(g.columns(), page, F.lit(0), F.lit(1.0), 2.0))
    both = settled(both, "box", g.device_box(F.col("v.x"), F.col("v.y"), F.col("v.w"), F.col("v.h"), width, height)).where("box is not null")
    edge = g.columns("box.")
    grown = F.when(F.col("kind") == "mask", g.expand(edge, 2, width, height)).otherwise(g.expand(edge, 3, width, height))
    return settled(both, "z", grown).select("doc_id", "page_index", "kind", "ord", *[F.col(f"z.{c}").cast("long").alias(f"z{c}") for c in ("x0", "y0", "x1", "y1")])
