"""Text evidence against marks, page by page.

A document is one row: its pages, each with its text items and the marks that lie on it. Overlaps are decided by
array expressions inside the row, so no item is ever shuffled; marks of a table of their own join once, as one array
per document (``attach``), before anything is decided.

pages: array of page_index, items (ord, str, x0, y0, x1, y1) and marks (mark_no, page_index, x0, y0, x1, y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.geometry import Box
from inkfold.functions.predicates import touches
from inkfold.functions.text import collapsed
from inkfold.sources.tables import settled

_BOX = ("x0", "y0", "x1", "y1")
MARK = "mark_no long, page_index long, x0 double, y0 double, x1 double, y1 double"


def attach(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` (doc_id, pages of page_index and items) with each page's marks; a mark on a page that the document
    lacks stays, on a page without items. marks: doc_id, mark_no, page_index, x0, y0, x1, y1."""
    per_doc = marks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("mark_no", "page_index", *_BOX))).alias("marks"))
    joined = docs.join(per_doc, "doc_id", "full").withColumn("marks", F.coalesce("marks", F.array().cast(f"array<struct<{MARK.replace(' ', ':').replace(',:', ',')}>>")))
    here = F.coalesce("pages", F.array().cast(docs.schema["pages"].dataType))
    own = F.transform(here, lambda p: F.struct(p["page_index"], p["items"], F.filter("marks", lambda m: m["page_index"] == p["page_index"]).alias("marks")))
    known = F.transform(here, lambda p: p["page_index"])
    lost = F.array_sort(F.array_except(F.transform("marks", lambda m: m["page_index"]), known))
    items = docs.schema["pages"].dataType.elementType["items"].dataType
    empty = F.transform(lost, lambda k: F.struct(k.alias("page_index"), F.array().cast(items).alias("items"), F.filter("marks", lambda m: m["page_index"] == k).alias("marks")))
    return joined.select("doc_id", F.concat(own, empty).alias("pages"))


def _box(x: Column) -> Box:
    return tuple(x[c] for c in _BOX)  # type: ignore[return-value]


def _touched(item: Column, marks: Column) -> Column:
    return F.exists(marks, lambda m: touches(_box(item), _box(m)))


def _words(items: Column) -> Column:
    return F.transform(items, lambda i: i["str"])


def joined_text(items: Column) -> Column:
    """The visible text of items, in order; empty where there is none. An item without any collapses into its blanks."""
    return collapsed(F.array_join(_words(items), " "))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, ord, str, x0, y0, x1, y1 of the items that touch a mark."""
    pages = docs.select("doc_id", F.explode_outer("pages").alias("p"))
    gone = F.filter("p.items", lambda i: _touched(i, F.col("p.marks")))
    return pages.select("doc_id", "p.page_index", F.explode_outer(gone).alias("i")).where("i is not null").select("doc_id", "page_index", "i.*")


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id, items_before, items_removed and the text that stays of each document with items."""

    def kept(p: Column) -> Column:
        return F.when(F.size(p["marks"]) == 0, _words(p["items"])).otherwise(_words(F.filter(p["items"], lambda i: ~_touched(i, p["marks"]))))

    before = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + F.size(p["items"]))
    out = settled(docs.select("doc_id", before.alias("items_before"), F.flatten(F.transform("pages", kept)).alias("words")), "text", F.array_join("words", " "))
    return out.where("items_before > 0").select("doc_id", "items_before", (F.col("items_before") - F.size("words")).cast("long").alias("items_removed"), "text")


def checked(docs: DataFrame, overlaid: Column) -> DataFrame:
    """doc_id, overlaid, pages of page_index, text (what the candidate shows outside the marks), and selections: mark_no
    and value (visible source text under the mark). The candidate keeps no item that touches a mark, unless
    ``overlaid``: painted over only, it keeps all."""

    def flagged(p: Column) -> Column:
        """Each item is held against the page's marks once."""
        hit = F.when(F.size(p["marks"]) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(p["items"], lambda i: _touched(i, p["marks"])))
        return F.struct(p["page_index"].alias("page_index"), p["items"].alias("items"), p["marks"].alias("marks"), hit.alias("hit"))

    def sorted_out(p: Column) -> Column:
        bare = F.size(p["hit"]) == 0
        clear = F.when(bare, p["items"]).otherwise(F.filter(p["items"], lambda i, k: ~F.get(p["hit"], k)))
        under = F.when(bare, F.slice(p["items"], 1, 0)).otherwise(F.filter(p["items"], lambda i, k: F.get(p["hit"], k)))
        return F.struct(p["page_index"].alias("page_index"), p["marks"].alias("marks"), under.alias("under"), joined_text(clear).alias("text"))

    def selection(p: Column, m: Column) -> Column:
        value = joined_text(F.filter(p["under"], lambda i: touches(_box(i), _box(m))))
        return F.struct(m["mark_no"].alias("mark_no"), value.alias("value"))

    def page(p: Column) -> Column:
        return F.struct(p["page_index"].alias("page_index"), p["text"].alias("text"), F.transform(p["marks"], lambda m: selection(p, m)).alias("selections"))

    pages = F.transform(F.transform(F.transform("pages", flagged), sorted_out), page)
    return settled(docs.select("doc_id", overlaid.alias("overlaid"), "pages"), "found", pages).select("doc_id", "overlaid", F.col("found").alias("pages"))


def selections(found: DataFrame) -> DataFrame:
    """doc_id, page_index, mark_no, value, remaining, and duplicate, the first candidate page whose text outside the
    marks holds the value, of every mark."""

    def one(p: Column, s: Column) -> Column:
        holding = F.filter("pages", lambda q: F.contains(q["text"], s["value"]))
        duplicate = F.when(s["value"] != "", F.array_min(F.transform(holding, lambda q: q["page_index"])))
        return F.struct(p["page_index"].alias("page_index"), s["mark_no"].alias("mark_no"), s["value"].alias("value"), (F.col("overlaid") & (s["value"] != "")).alias("remaining"), duplicate.alias("duplicate"))

    all_ = F.flatten(F.transform("pages", lambda p: F.transform(p["selections"], lambda s: one(p, s))))
    return found.select("doc_id", F.explode_outer(all_).alias("s")).where("s is not null").select("doc_id", "s.*")


def text_checks(found: DataFrame) -> DataFrame:
    """Every mark with outcome and reason: fail if visible text of the candidate touches it; and duplicate, as above."""
    return selections(found).select(
        "doc_id", "mark_no", "page_index", F.when(F.col("remaining"), "fail").otherwise("pass").alias("outcome"),
        F.when(F.col("remaining"), "verify.text.remaining-text").otherwise("verify.text.clear").alias("reason_code"), "duplicate",
    )


def page_text(found: DataFrame) -> DataFrame:
    """doc_id, page_index, text of the candidate's pages that show any."""
    return found.select("doc_id", F.explode_outer("pages").alias("p")).where("p.text <> ''").select("doc_id", "p.page_index", "p.text")


def duplicate_warnings(found: DataFrame) -> DataFrame:
    """doc_id, mark_no, page_index of the first candidate page whose unmarked text holds a mark's value."""
    return selections(found).where("duplicate is not null").select("doc_id", "mark_no", F.col("duplicate").alias("page_index"))
