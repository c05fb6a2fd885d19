"""Worker messages: which a handler would take, field by field, and what a handler answers.

A message is a row of typed fields; a field that is absent or of another type is null. Guards never pass on a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import policy as pol
from inkfold.functions.geometry import finite

# Fixed values.
TRANSFORM_VERSIONS = ("transformEngine", "redactionPolicy", "savePolicy")
VERIFY_VERSIONS = ("verifyEngine", "verifyPolicy")
CHECKPOINTS = ("reopened", "checks-done")
SELF_CHECKS = ("ok", "failed")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _every(array: str, rule) -> Column:
    """All elements hold; an absent list does not."""
    return _sure(F.forall(array, lambda x: _sure(x.isNotNull() & rule(x))))


def _versions(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"policy.{n}") == pol.VERSIONS[n])
    return _sure(out)


def _transform_rect(r: Column) -> Column:
    """Whole page from 0 on, finite and ordered edges."""
    page = finite(r["page"]) & (r["page"] == F.floor(r["page"])) & (r["page"] >= 0)
    return page & finite(r["x0"], r["y0"], r["x1"], r["y1"]) & (r["x0"] < r["x1"]) & (r["y0"] < r["y1"])


def _verify_rect(r: Column) -> Column:
    out = r["selection_id"].isNotNull()
    for c in ("page", "x0", "y0", "x1", "y1", "number"):
        out = out & r[c].isNotNull()
    return out


def _expected_page(p: Column) -> Column:
    return p["page"].isNotNull() & (F.size(p["view"]) == 4) & F.forall(p["view"], lambda v: v.isNotNull()) & p["rotation"].isin(0, 90, 180, 270)


def guards() -> dict[str, Column]:
    """By message type, whether a row of that type is a message of it."""
    ready = (
        F.col("payload_bytes").isNotNull() & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("byte_length") == F.col("payload_bytes"))
        & F.col("self_check").isin(*SELF_CHECKS) & _versions(TRANSFORM_VERSIONS)
    )
    return {
        "OPEN_SOURCE": F.lit(True),
        "APPLY_REDACTIONS": F.col("payload_bytes").isNotNull() & (F.size("rects") > 0) & _every("rects", _transform_rect) & _versions(TRANSFORM_VERSIONS) & F.col("sanitize").isNotNull(),
        "CANDIDATE_READY": ready,
        "TRANSFORM_FAILED": F.col("reason").isNotNull(),
        "VERIFY_CANDIDATE": (
            F.col("source_bytes").isNotNull() & F.col("payload_bytes").isNotNull() & F.col("sha256").isNotNull()
            & _every("rects", _verify_rect) & _every("expected_pages", _expected_page) & _versions(VERIFY_VERSIONS)
        ),
        "VERIFY_CHECKPOINT": F.col("checkpoint").isin(*CHECKPOINTS),
        "VERIFY_RESULT": F.col("has_result"),
        "VERIFY_FAILED": F.col("reason").isin(*pol.VERIFY_OUTCOMES),
    }


def guarded(messages: DataFrame) -> DataFrame:
    """``messages`` with is_valid: a row of an unknown type, or that its type's guard does not pass, is none."""
    valid = F.lit(False)
    for kind, rule in guards().items():
        valid = F.when(F.col("type") == kind, _sure(rule)).otherwise(valid)
    return messages.withColumn("is_valid", valid)


def transform_answers(requests: DataFrame) -> DataFrame:
    """request_id, status, sha256 and byte_length of the candidate where there is one. requests: guarded rows with what
    applying them gave: candidate (null where the engine failed), source_pages, candidate_pages (null where it does not
    reopen), renders. In order: the message, the engine, the self-check."""
    checked = _sure((F.col("candidate_pages") > 0) & (F.col("candidate_pages") == F.col("source_pages")) & F.col("renders"))
    status = F.when(~F.col("is_valid"), "invalid-request").when(F.col("candidate").isNull(), "engine-error").when(~checked, "self-check-failed").otherwise("CANDIDATE_READY")
    out = requests.withColumn("status", status)
    ready = F.col("status") == "CANDIDATE_READY"
    return out.select("request_id", "status", F.when(ready, F.sha2("candidate", 256)).alias("sha256"), F.when(ready, F.octet_length("candidate").cast("double")).alias("byte_length"))


def verify_answers(requests: DataFrame) -> DataFrame:
    """request_id, status, outcome. requests: guarded rows with candidate (binary), candidate_size, expected_sha256,
    candidate_opens, source_opens. The size is judged before the digest and the digest before anything is opened."""
    status = (
        F.when(~F.col("is_valid"), "protocol").when(~_sure(F.col("candidate_size") <= pol.MAX_CANDIDATE_BYTES), "budget-exhausted")
        .when(~_sure(F.sha2("candidate", 256) == F.col("expected_sha256")), "digest-mismatch").when(~_sure(F.col("candidate_opens")), "parse-error")
        .when(~_sure(F.col("source_opens")), "source-unavailable").otherwise("VERIFY_RESULT")
    )
    return requests.withColumn("status", status).select("request_id", "status", F.coalesce(pol.lookup(pol.VERIFY_OUTCOMES, F.col("status")), F.lit("pass")).alias("outcome"))
