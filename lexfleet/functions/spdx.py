"""SPDX identifier functions."""

from pyspark.sql import Column, functions as F

from . import fixed
from .text import col

_LOWER = {}
for _id in fixed.KNOWN_SPDX:
    _LOWER.setdefault(_id.lower(), _id)


def _literal_map(d) -> Column:
    """A constant map, folded once by the optimizer (separators are control characters)."""
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in sorted(d.items()))
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def canonical_spdx(c) -> Column:
    """Known identifier in its usual spelling, whatever the case; else NULL."""
    return F.try_element_at(_literal_map(_LOWER), F.lower(F.trim(col(c))))


def normalise_spdx(c) -> Column:
    """Alias spellings and letter case folded to one identifier."""
    t = F.trim(col(c))
    base = F.regexp_replace(t, r"\+$", "")
    known = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{k}" for k in fixed.KNOWN_SPDX)), F.lit("\x1e"), F.lit("\x1f"))
    plus = F.when(
        t.endswith("+") & F.try_element_at(known, base).isNotNull(),
        F.coalesce(F.try_element_at(known, F.concat(base, F.lit("-or-later"))),
                   F.try_element_at(known, F.concat(base, F.lit("-only")))),
    )
    return F.coalesce(F.try_element_at(_literal_map(fixed.SPDX_ALIASES), t), plus, canonical_spdx(t), t)


def valid_spdx(c) -> Column:
    t = F.trim(col(c))
    base = F.regexp_replace(t, r"\+$", "")
    return F.coalesce(t.rlike(r"(?i)^LicenseRef-.") | canonical_spdx(base).isNotNull(), F.lit(False))


def is_expression(c) -> Column:
    up = F.upper(col(c))
    return up.contains(" OR ") | up.contains(" AND ") | up.contains(" WITH ")


def expression_atoms(c) -> Column:
    parts = F.split(col(c), r"[ ()\t]+")
    return F.filter(parts, lambda p: (p != "") & ~F.upper(p).isin("OR", "AND", "WITH"))


def expression_is_valid(c) -> Column:
    atoms = expression_atoms(c)
    return (F.size(atoms) > 0) & F.forall(atoms, lambda a: valid_spdx(a))


def licence_ref(raw, source) -> Column:
    """Raw licence string -> struct(spdx, raw, source, expression, resolved, confidence).

    An expression is kept whole; a string that is neither a valid expression nor
    a known identifier stays unresolved with its raw spelling.
    """
    t = F.trim(F.coalesce(col(raw), F.lit("")))
    src = F.lit(source) if isinstance(source, str) else source
    norm = normalise_spdx(t)
    expr_text = is_expression(t)
    expr_ok = expr_text & expression_is_valid(t)
    id_ok = ~expr_text & (t != "") & valid_spdx(norm)
    spdx = F.when(expr_ok, t).when(id_ok, norm).otherwise(F.lit(""))
    confidence = (
        F.when(t == "", F.lit(""))
        .when(expr_ok, F.lit("medium")).when(id_ok, F.lit("high")).otherwise(F.lit("low"))
    )
    return F.struct(
        spdx.alias("spdx"),
        t.alias("raw"),
        src.alias("source"),
        expr_ok.alias("expression"),
        (expr_ok | id_ok).alias("resolved"),
        confidence.alias("confidence"),
    )


def lookup_key(c) -> Column:
    """Join key for the licence dimension."""
    return F.upper(normalise_spdx(c))
