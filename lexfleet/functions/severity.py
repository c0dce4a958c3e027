"""Severity, confidence and date rules as columns."""

from pyspark.sql import Column, functions as F

from . import fixed
from .text import col


def _weight(c, table) -> Column:
    out = None
    for name, w in table.items():
        out = F.when(c == name, F.lit(w)) if out is None else out.when(c == name, F.lit(w))
    return out


def severity_weight(c) -> Column:
    return F.coalesce(_weight(col(c), fixed.SEVERITY_WEIGHT), F.lit(0))


def confidence_weight(c) -> Column:
    return F.coalesce(_weight(F.upper(col(c)), fixed.CONFIDENCE_WEIGHT), F.lit(0))


def confidence_from_weight(w) -> Column:
    return F.when(w >= 2, F.lit("HIGH")).when(w == 1, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def severity_from_weight(w) -> Column:
    return (
        F.when(w == 3, F.lit("BLOCK")).when(w == 2, F.lit("CONDITION"))
        .when(w == 1, F.lit("NOTE")).otherwise(F.lit("INFO"))
    )


def downgrade_confidence(c) -> Column:
    return F.when(col(c) == "HIGH", F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def weakest_confidence(*cols) -> Column:
    return confidence_from_weight(F.least(*[confidence_weight(c) for c in cols]))


def effective_severity(severity, confidence, allow_medium_blockers=False) -> Column:
    """The confidence gate: only HIGH may block, LOW is never more than a note."""
    s, c = col(severity), col(confidence)
    gated = F.when(s.isin("BLOCK", "CONDITION"), F.lit("NOTE")).otherwise(s)
    medium = s if allow_medium_blockers else F.when(s == "BLOCK", F.lit("CONDITION")).otherwise(s)
    return F.when(c == "HIGH", s).when(c == "MEDIUM", medium).otherwise(gated)


def parse_date(c) -> Column:
    """Strict YYYY-MM-DD, anything else NULL."""
    t = col(c).cast("string")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def citation_stale(retrieved_at, today) -> Column:
    """More than 180 days old, or present but unreadable. Missing means fresh."""
    r = F.coalesce(col(retrieved_at).cast("string"), F.lit(""))
    t = F.lit(today) if isinstance(today, str) else F.coalesce(today.cast("string"), F.lit(""))
    return (
        F.when((r == "") | (t == ""), F.lit(False))
        .when(parse_date(r).isNull(), F.lit(True))
        .when(parse_date(t).isNull(), F.lit(False))
        .otherwise(F.datediff(parse_date(t), parse_date(r)) > fixed.CITATION_STALE_DAYS)
    )


def platform_stale(last_verified, staleness_days, today) -> Column:
    """Older than the platform's own window; an unreadable date counts as fresh."""
    t = F.lit(today) if isinstance(today, str) else today
    return F.coalesce(F.datediff(parse_date(t), parse_date(last_verified)) > col(staleness_days), F.lit(False))


def exception_live(expires, today) -> Column:
    t = F.trim(F.lit(today) if isinstance(today, str) else today)
    return (t == "") | (t <= F.trim(col(expires)))


def provenance_rank(c) -> Column:
    return F.coalesce(_weight(col(c), fixed.PROVENANCE_RANK), F.lit(0))



def verdict_from_rank(r) -> Column:
    return (
        F.when(r == 3, F.lit("DO_NOT_SHIP")).when(r == 2, F.lit("UNDETERMINED"))
        .when(r == 1, F.lit("SHIP_CONDITIONAL")).otherwise(F.lit("SHIP"))
    )
