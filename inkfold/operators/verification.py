"""Document checks, and the assembly of all checks into reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.geometry import rounded_rotation
from inkfold.functions.policy import outcome_of, outcome_rank

_BOX = ("cx0", "cy0", "cx1", "cy1")


def _row(check: str, ok: Column, bad: str, ord_: Column, page: Column | None = None) -> list[Column]:
    return [
        F.lit(f"document.{check}").alias("check"), (page if page is not None else F.lit(-1)).cast("long").alias("page"), F.when(ok, "pass").otherwise("fail").alias("outcome"),
        F.when(ok, f"verify.document.{check}.ok").otherwise(f"verify.document.{check}.{bad}").alias("reason_code"), ord_.cast("long").alias("ord"),
    ]


def introduced(names: DataFrame) -> DataFrame:
    """doc_id, family, name: on the candidate's side but not on the source's. Removal is allowed."""
    side = lambda s: names.where(F.col("side") == s).select("doc_id", "family", "name").distinct()
    return side("candidate").join(side("source"), ["doc_id", "family", "name"], "left_anti")


def document_checks(docs: DataFrame, expected: DataFrame, candidate: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, check, page (-1 for the document), outcome, reason_code, ord. Starts from the requested
    documents and expected pages; a page that the candidate lacks fails its view and has no rotation row."""
    e = expected.select("doc_id", F.col("page_index"), *[F.col(c).alias(f"e_{c}") for c in (*_BOX, "rotation")])
    c = candidate.select("doc_id", "page_index", F.lit(True).alias("present"), *_BOX, "rotation")
    counts = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    sizes = docs.select("doc_id").join(counts(expected, "n_expected"), "doc_id", "left").join(counts(candidate, "n_candidate"), "doc_id", "left")
    count_ok = F.coalesce("n_expected", F.lit(0)) == F.coalesce("n_candidate", F.lit(0))
    count = sizes.select("doc_id", *_row("page-count", count_ok, "mismatch", F.lit(0)))

    pages = e.join(docs.select("doc_id"), "doc_id", "left_semi").join(c, ["doc_id", "page_index"], "left")
    there = F.coalesce("present", F.lit(False))
    view_ok = F.coalesce(there & (F.col("cx0") == F.col("e_cx0")) & (F.col("cy0") == F.col("e_cy0")) & (F.col("cx1") == F.col("e_cx1")) & (F.col("cy1") == F.col("e_cy1")), F.lit(False))
    view = pages.select("doc_id", *_row("page-view", view_ok, "mismatch", 1 + 2 * F.col("page_index"), F.col("page_index")), there.alias("there"))
    view = view.withColumn("reason_code", F.when(F.col("there"), F.col("reason_code")).otherwise("verify.document.page-view.missing")).drop("there")
    turn_ok = rounded_rotation(F.col("rotation")) == rounded_rotation(F.col("e_rotation"))
    turn = pages.where(there).select("doc_id", *_row("page-rotation", turn_ok, "mismatch", 2 + 2 * F.col("page_index"), F.col("page_index")))

    extra = introduced(names).select("doc_id", "family").distinct().withColumn("extra", F.lit(True))
    families = docs.select("doc_id", F.explode(F.array(*map(F.lit, ("js-actions", "attachments", "fields")))).alias("family")).join(extra, ["doc_id", "family"], "left")
    clean = F.col("extra").isNull()
    place = F.when(F.col("family") == "js-actions", 1_000_000).when(F.col("family") == "attachments", 1_000_001).otherwise(1_000_002)
    subset = families.select(
        "doc_id", F.concat(F.lit("document."), "family").alias("check"), F.lit(-1).cast("long").alias("page"), F.when(clean, "pass").otherwise("fail").alias("outcome"),
        F.concat(F.lit("verify.document."), "family", F.when(clean, ".ok").otherwise(".introduced")).alias("reason_code"), place.cast("long").alias("ord"),
    )
    return count.unionByName(view).unionByName(turn).unionByName(subset)


def assembled_selections(requested: DataFrame, checks: DataFrame) -> DataFrame:
    """Every requested (doc_id, mark_no) with outcome, reason_code and both aspects' codes. checks:
    doc_id, mark_no, aspect, outcome, reason_code, and warned if known. A missing aspect is indeterminate whatever the other says."""
    of = lambda aspect, what: F.max(F.when(F.col("aspect") == aspect, F.col(what)))
    found = checks.groupBy("doc_id", "mark_no").agg(
        (F.bool_or("warned") if "warned" in checks.columns else F.lit(False)).alias("warned"), of("text", "outcome").alias("text_outcome"), of("text", "reason_code").alias("text_code"), of("visual", "outcome").alias("visual_outcome"), of("visual", "reason_code").alias("visual_code"),
    )
    all_ = requested.select("doc_id", "mark_no", "page_index").join(found, ["doc_id", "mark_no"], "left")
    t, v = F.col("text_outcome"), F.col("visual_outcome")
    outcome = F.when(t.isNull() | v.isNull(), "indeterminate").otherwise(outcome_of(F.greatest(outcome_rank(t), outcome_rank(v))))
    code = (
        F.when(t.isNull() & v.isNull(), "verify.report.selection-missing").when(t.isNull() | v.isNull(), "verify.report.aspect-missing")
        .when(outcome_rank(v) > outcome_rank(t), F.col("visual_code")).otherwise(F.col("text_code"))
    )
    return all_.select("doc_id", "mark_no", "page_index", outcome.alias("outcome"), code.alias("reason_code"), "text_code", "visual_code", F.coalesce("warned", F.lit(False)).alias("warned"))


def outside_fold(pages: DataFrame) -> DataFrame:
    """doc_id, outcome, reason_code: the worst page outcome, and the first page's reason at that level.
    pages: doc_id, ord, outcome, reason_code."""
    rank = outcome_rank(F.col("outcome"))
    best = pages.groupBy("doc_id").agg(F.min_by("reason_code", F.struct(-rank, "ord")).alias("reason_code"), F.max(rank).alias("rank"))
    return best.select("doc_id", outcome_of(F.col("rank")).alias("outcome"), F.when(F.col("rank") == 0, "verify.visual.outside-ok").otherwise(F.col("reason_code")).alias("reason_code"))


def reports(docs: DataFrame, checks: DataFrame, selections: DataFrame, outside: DataFrame) -> DataFrame:
    """doc_id, outcome, reason_codes (each once, in order of first use), counts of each part."""
    at = lambda part, ord_, code: F.struct(F.lit(part).alias("part"), ord_.cast("long").alias("ord"), F.col(code).alias("code") if isinstance(code, str) else code.alias("code"))
    rank = F.max(outcome_rank(F.col("outcome")))
    combined = F.when(F.col("text_code").isNull() | F.col("visual_code").isNull(), F.col("reason_code"))
    # each part is read once: its worst outcome, its codes and its counts by document
    of_checks = checks.groupBy("doc_id").agg(rank.alias("r0"), F.collect_list(at(0, F.col("ord"), "reason_code")).alias("c0"))
    listed = F.array(*[at(1, F.col("mark_no") * 3 + k, c) for k, c in enumerate(("text_code", "visual_code", combined))])
    of_marks = selections.groupBy("doc_id").agg(rank.alias("r1"), F.flatten(F.collect_list(listed)).alias("c1"), F.count("*").alias("rect_count"), F.count_if("warned").alias("warnings"))
    of_pages = outside.groupBy("doc_id").agg(rank.alias("r2"), F.collect_list(at(2, F.lit(0), "reason_code")).alias("c2"))
    out = docs.select("doc_id").join(of_checks, "doc_id", "left").join(of_marks, "doc_id", "left").join(of_pages, "doc_id", "left")
    none = F.array().cast("array<struct<part:int,ord:bigint,code:string>>")
    used = F.filter(F.concat(*(F.coalesce(c, none) for c in ("c0", "c1", "c2"))), lambda x: x["code"].isNotNull())
    codes = F.array_distinct(F.transform(F.array_sort(used), lambda x: x["code"]))
    worst = F.greatest(*(F.coalesce(r, F.lit(0)) for r in ("r0", "r1", "r2")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", outcome_of(worst).alias("outcome"), F.array_join(codes, ",").alias("reason_codes"), zero("rect_count"), zero("warnings"))


def latest(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The newest request of each key; the others are superseded."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return requests.withColumn("rank", rank).where("rank = 1").drop("rank")
