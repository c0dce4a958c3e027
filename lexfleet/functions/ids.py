"""Identifiers, hashes and display names as columns."""

from pyspark.sql import Column, functions as F

from .text import col


def package_id(ecosystem, name, version) -> Column:
    v = F.coalesce(col(version), F.lit(""))
    return F.concat(col(ecosystem), F.lit(":"), col(name), F.when(v == "", F.lit("")).otherwise(F.concat(F.lit("@"), v)))


def local_id(kind, rel) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit(":"), F.regexp_replace(col(rel), r"\\", "/"))


def finding_id(dependency_id, kind) -> Column:
    digest = F.sha2(F.concat(col(dependency_id), F.lit("\0"), col(kind)), 256)
    return F.concat(F.lit("f_"), F.substring(digest, 1, 12))


def intent_hash(schema_version=1, never_allow=None, block_on=None, ignore=None) -> Column:
    """Digest of the declared facts; list order and undeclared/zero do not collide."""
    def flag(c):
        return F.when(F.col(c), F.lit("true")).otherwise(F.lit("false"))

    def sorted_csv(c):
        return F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))

    empty = F.array().cast("array<string>")
    lines = [("schema_version", F.lit(str(schema_version))), ("project.name", F.coalesce(F.col("project_name"), F.lit("")))]
    lines += [("use.commercial", flag("use_commercial")), ("use.licence_model", F.col("use_licence_model"))]
    lines += [(f"use.{k}", flag(f"use_{k}")) for k in ("modified", "network_exposed", "distributed", "saas")]
    for k in ("mau", "employees", "revenue_eur"):
        c = F.col(f"scale_{k}")
        lines.append((f"scale.{k}.declared", F.when(c.isNotNull(), F.lit("true")).otherwise(F.lit("false"))))
        lines.append((f"scale.{k}", F.coalesce(c, F.lit(0)).cast("string")))
    lines.append(("territories", sorted_csv(F.col("territories"))))
    lines.append(("policy.never_allow", sorted_csv(empty if never_allow is None else never_allow)))
    lines.append(("policy.block_on", sorted_csv(empty if block_on is None else block_on)))
    text = F.concat(*[F.concat(F.lit(k + "="), v, F.lit("\n")) for k, v in lines])
    if ignore is not None:
        rules = F.transform(ignore, lambda r: F.concat(F.lit("policy.ignore="), r["path"], F.lit("|"), r["reason"], F.lit("\n")))
        text = F.concat(text, F.array_join(rules, ""))
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def uuid_from_digest(hex_digest) -> Column:
    """First 16 bytes of a digest as a version-5 style UUID."""
    h = col(hex_digest)
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(nibble, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def purl(ecosystem, name, version) -> Column:
    """Package URL, empty for ecosystems without one."""
    eco = F.lower(col(ecosystem))
    kind = (
        F.when(eco == "npm", "npm").when(eco == "pypi", "pypi")
        .when(eco == "go", "golang").when(eco == "cargo", "cargo")
    )

    def escape(c):
        out = F.replace(c, F.lit("%"), F.lit("%25"))
        for ch, code in ((" ", "%20"), ("#", "%23"), ("?", "%3F"), ("[", "%5B"), ("]", "%5D")):
            out = F.replace(out, F.lit(ch), F.lit(code))
        return out

    v = F.coalesce(col(version), F.lit(""))
    tail = F.when(v != "", F.concat(F.lit("@"), escape(v))).otherwise(F.lit(""))
    url = F.concat(F.lit("pkg:"), kind, F.lit("/"), escape(col(name)), tail)
    return F.when(kind.isNotNull() & (F.coalesce(col(name), F.lit("")) != ""), url).otherwise(F.lit(""))


def display_name(dep_id) -> Column:
    """Identifier without its ecosystem prefix and version."""
    c = col(dep_id)
    rest = F.when(c.contains(":"), F.regexp_replace(c, r"^[^:]*:", "")).otherwise(c)
    cut = F.regexp_replace(rest, r"^(.+)@[^@]*$", "$1")
    return F.when(cut == "", c).otherwise(cut)


def licence_label(spdx, raw) -> Column:
    s, r = F.trim(col(spdx)), F.trim(col(raw))
    return F.coalesce(F.when(s != "", s), F.when(r != "", r), F.lit("no licence declared"))
