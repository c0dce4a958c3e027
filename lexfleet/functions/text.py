"""Licence-text and string functions as Catalyst columns (no Python per row)."""

from pyspark.sql import Column, functions as F

from . import fixed, sqltext as q

# curly quotes, en/em dash, no-break spaces, byte-order mark (the last one is dropped)
_FANCY = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u202f\ufeff"
_PLAIN = "''\"\"--  "


def col(c):
    return F.col(c) if isinstance(c, str) else c


def normalise_text(c) -> Column:
    """Fold typographic characters, lower-case, collapse every Unicode whitespace run."""
    folded = F.lower(F.translate(col(c), _FANCY, _PLAIN))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def recognise_licence(normalised: str) -> Column:
    """First licence whose phrases all occur (and whose excluded phrases do not),
    over a column that already went through `normalise_text`."""
    c = q.ident(normalised)
    branches = []
    for spdx, every, none in fixed.LICENCE_PHRASES:
        hit = q.contains_all(c, every) + (f" AND NOT {q.contains_any(c, none)}" if none else "")
        branches.append((hit, q.quote(spdx)))
    return F.expr(q.case(branches))


def _prose(lowered: str, pick) -> Column:
    c = q.ident(lowered)
    first = q.case((f"contains({c}, {q.quote(n)})", q.quote(pick(n, spdx))) for n, spdx in fixed.PROSE_NEEDLES)
    return F.expr(f"CASE WHEN contains({c}, {q.quote(fixed.PROSE_GATE)}) THEN {first} END")


def prose_needle(lowered: str) -> Column:
    """First needle found in (lower-cased) text that talks about licensing, else NULL."""
    return _prose(lowered, lambda needle, spdx: needle)


def prose_licence(lowered: str) -> Column:
    """SPDX id behind the first prose needle, else NULL."""
    return _prose(lowered, lambda needle, spdx: spdx)


def has_brand_noun(normalised: str) -> Column:
    return F.expr(q.contains_any(q.ident(normalised), fixed.BRAND_NOUNS))


def has_brand_reservation(normalised: str) -> Column:
    c = q.ident(normalised)
    return F.expr(q.contains_any(c, fixed.BRAND_NOUNS) + " AND " + q.contains_any(c, fixed.BRAND_NEGATIONS))


def brand_evidence(c) -> Column:
    """struct(line, excerpt): first line with a brand noun, else first non-blank line."""
    lines = F.split(col(c), "\n")
    numbered = F.transform(
        lines,
        lambda x, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("excerpt")),
    )
    nouns = "|".join(fixed.BRAND_NOUNS)
    noun = F.filter(numbered, lambda s: normalise_text(s["excerpt"]).rlike(nouns))
    filled = F.filter(numbered, lambda s: s["excerpt"] != "")
    return F.coalesce(
        F.try_element_at(noun, F.lit(1)),
        F.try_element_at(filled, F.lit(1)),
        F.struct(F.lit(0).alias("line"), F.lit("").alias("excerpt")),
    )


def front_matter_licence_raw(c) -> Column:
    """Values of licence keys in a leading `---` block, in order (array)."""
    body = F.regexp_replace(col(c), "\r\n", "\n")
    lines = F.split(body, "\n")
    tail = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x))
    stop = F.array_position(tail, "---")
    block = F.when(stop > 0, F.slice(tail, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(tail)
    keyed = F.filter(block, lambda x: F.lower(F.trim(F.split(x, ":", 2)[0])).isin("license", "licence", "license_name")
                     & x.contains(":"))
    values = F.transform(keyed, lambda x: F.trim(F.split(x, ":", 2)[1]))
    return F.when(F.trim(lines[0]) == "---", values).otherwise(F.array().cast("array<string>"))


def config_json_licence_raw(c) -> Column:
    """First non-blank of `license`, `licence` in a JSON object (NULL when unparseable)."""
    obj = F.try_parse_json(col(c))
    pick = [F.try_variant_get(obj, f"$.{k}", "string") for k in ("license", "licence")]
    return F.coalesce(*[F.when(F.trim(p) != "", p) for p in pick])


def base_name(rel) -> Column:
    return F.element_at(F.split(col(rel), "/"), -1)


def dir_name(rel) -> Column:
    """Parent directory, `.` at the root."""
    d = F.regexp_extract(col(rel), r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)



def is_licence_file_name(base) -> Column:
    low = F.lower(col(base))
    prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in fixed.LICENCE_FILE_PREFIXES) + ")."
    names = "^(?:" + "|".join(n.replace(".", r"\.") for n in fixed.LICENCE_FILE_NAMES) + ")$"
    return low.rlike(names) | low.rlike(prefix)


def file_extension(base) -> Column:
    return F.lower(F.regexp_extract(col(base), r"(\.[^.]*)$", 1))


def brand_stem(base) -> Column:
    low = F.lower(col(base))
    return F.when(low.startswith("."), F.lit("")).otherwise(F.regexp_replace(low, r"\.[^.]*$", ""))


def is_range(v) -> Column:
    t = F.trim(col(v))
    return F.coalesce(
        (t != "") & (t.rlike(r"[\^~*<>=|]") | F.lower(t).isin("latest", "any")), F.lit(False)
    )


def clean_version(v) -> Column:
    t = F.regexp_replace(F.trim(col(v)), r"^\^", "")
    t = F.regexp_replace(t, r"^~", "")
    t = F.split(t, ",")[0]
    return F.trim(F.regexp_replace(t, r"^[=<>!~\^ ]+", ""))


def collapse_space(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[ \t\n\r]+", " "))


def safe_relative(path) -> Column:
    """True for a path that may leave the project in a payload: relative, no `..`."""
    p = F.trim(col(path))
    return (p != "") & ~p.contains("..") & ~p.rlike(r"^(?:/|\\|.:)")


def safe_paths(paths) -> Column:
    return F.filter(F.transform(col(paths), lambda p: F.trim(p)), safe_relative)


def markdown_escape(c) -> Column:
    one_line = F.translate(col(c), "\n\r", " ")
    return F.regexp_replace(one_line, r"([\\`*_\[\]<>|])", r"\\$1")


def relative_uri(path) -> Column:
    """Evidence path as a relative URI, empty when it is not one."""
    p = F.regexp_replace(F.trim(F.regexp_replace(col(path), r"\\", "/")), r"^\./", "")
    bad = p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"[?#]")
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit("")).when(bad, F.lit("")).otherwise(p)


def valid_territory(c) -> Column:
    t = F.trim(col(c))
    return t.isin(fixed.REGION_GROUPS) | t.rlike("^[A-Z]{2}$")


def strip_code_fence(c) -> Column:
    """Text inside a leading Markdown fence; text without one stays as it is."""
    t = F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")
    body = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)$", 1)
    inner = F.when(body.contains("```"), F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(t)


def clip_text(c, n=None) -> Column:
    """Drop control characters (tab and newline stay). With n, a longer text ends in an ellipsis."""
    clean = F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""), r"[\x00-\x08\x0b-\x1f\x7f]", "")
    if n is None:
        return clean
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n), F.lit("\u2026"))).otherwise(clean)


def url_host(c) -> Column:
    """Lower-cased host of an http(s) URL, NULL when there is none."""
    h = F.lower(F.regexp_extract(col(c), r"(?i)^https?://(?:[^/?#@]*@)?([A-Za-z0-9][A-Za-z0-9.\-]*)", 1))
    return F.when(h != "", F.regexp_replace(h, r"\.$", ""))


def host_suffixes(host) -> Column:
    """Every dot-suffix of a host, longest first, so a suffix match becomes an
    equi-join key."""
    labels = F.split(col(host), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def path_prefixes(path) -> Column:
    """`a/b/c` -> [a, a/b, a/b/c]: a prefix match becomes an equi-join key."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
