"""Package manifests and lockfiles as declared-dependency rows.

Input rows are (project_id, rel, text). JSON and line formats are parsed by
Catalyst expressions; only TOML manifests and nested version-1 npm locks, which
have no built-in reader, go through Arrow batches of whole files.
"""

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.functions import text as tx
from lexfleet.session import map_in_pandas, fact_join

DECLARED = [
    "project_id", "source_path", "ecosystem", "name", "version", "is_range", "direct", "licence_raw", "line", "dev",
    "optional", "local", "path_dep",
]
DECLARED_SCHEMA = (
    "project_id string, source_path string, ecosystem string, name string, version string, is_range boolean, direct boolean, "
    "licence_raw string, line int, dev boolean, optional boolean, local boolean, path_dep string"
)


def _declared(df: DataFrame, ecosystem: str, **columns) -> DataFrame:
    base = {
        "is_range": F.lit(False), "direct": F.lit(True), "licence_raw": F.lit(""), "line": F.lit(0), "dev": F.lit(False),
        "optional": F.lit(False), "local": F.lit(False), "path_dep": F.lit(""), "ecosystem": F.lit(ecosystem),
        "project_id": F.col("project_id"), "source_path": F.col("rel"),
    } | columns
    return df.select(*[base[c].alias(c) for c in DECLARED])


def _parse_warning(df: DataFrame, code: str) -> DataFrame:
    return df.select("project_id", F.lit(code).alias("code"), F.col("rel").alias("path"))


# ---- JSON ----------------------------------------------------------------------

def json_scalar(v: Column, path: str) -> Column:
    """String, number or boolean member as text; objects and arrays are empty."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "string")
    scalar = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")
    return F.coalesce(F.when(scalar, value), F.lit(""))


def _is_true(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce((kind == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def _object(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def parse_json_files(files: DataFrame) -> DataFrame:
    """Adds `doc` (variant); `ok` is false when the text is not one JSON object."""
    doc = F.try_parse_json("text")
    return files.withColumn("doc", doc).withColumn(
        "ok", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))


NPM_GROUPS = [  # fixed values: (key, dev, optional)
    ("dependencies", False, False), ("devDependencies", True, False), ("peerDependencies", False, False),
    ("optionalDependencies", False, True), ("bundledDependencies", False, False),
]


def npm_manifest(files: DataFrame) -> DataFrame:
    """package.json: the five dependency groups in one generator."""
    docs = parse_json_files(files).filter("ok")
    groups = F.array(*[
        F.struct(_object(F.col("doc"), f"$.{k}").alias("deps"), F.lit(d).alias("dev"), F.lit(o).alias("optional")) for k, d, o in NPM_GROUPS])
    entries = (
        docs.select("project_id", "rel", F.inline(groups))
        .select("project_id", "rel", "dev", "optional", F.explode("deps").alias("name", "spec"))
        .withColumn("raw", F.when(F.schema_of_variant("spec") == "STRING", F.try_variant_get("spec", "$", "string")).otherwise(F.lit("")))
    )
    return _declared(entries, "npm", name=F.col("name"), version=tx.clean_version("raw"), is_range=tx.is_range("raw"),
                     dev=F.col("dev"), optional=F.col("optional"))


def npm_own_licence(files: DataFrame) -> DataFrame:
    docs = parse_json_files(files).filter("ok")
    d = F.col("doc")
    listed = F.coalesce(*[F.nullif(x, F.lit("")) for x in (json_scalar(d, "$.licenses[0].type"), json_scalar(d, "$.licenses[0]"))])
    own = F.coalesce(F.nullif(json_scalar(d, "$.license"), F.lit("")), listed, json_scalar(d, "$.licence"))
    return docs.select("project_id", "rel", own.alias("own_licence"))


def npm_name_from_path(path: str) -> Column:
    """Name after the last `node_modules/`, with its scope when it has one."""
    rest = F.regexp_replace(F.regexp_extract(path, r"^(?:.*)node_modules/(.*)$", 1), "/$", "")
    return F.when(rest.startswith("@"), F.regexp_extract(rest, r"^([^/]*(?:/[^/]*)?)", 1)).otherwise(F.split(rest, "/")[0])


def npm_lock(files: DataFrame) -> DataFrame:
    """package-lock v2/v3 `packages`; files without it as the nested v1 tree."""
    docs = parse_json_files(files).filter("ok")
    packages = docs.select("project_id", "rel", F.explode(_object(F.col("doc"), "$.packages")).alias("path", "entry"))
    named = packages.withColumn("name", npm_name_from_path("path")).filter(F.col("name") != "")
    e = F.col("entry")
    count = F.size(F.split("path", "node_modules/")) - 1
    licence = F.coalesce(F.nullif(json_scalar(e, "$.license"), F.lit("")), json_scalar(e, "$.licence"))
    flat = _declared(named, "npm", name=F.col("name"), version=json_scalar(e, "$.version"),
                     is_range=tx.is_range(json_scalar(e, "$.version")), direct=count <= 1, licence_raw=licence,
                     dev=_is_true(e, "$.dev"), optional=_is_true(e, "$.optional"))
    has_packages = F.exists(F.coalesce(F.map_keys(_object(F.col("doc"), "$.packages")), F.array().cast("array<string>")),
                            lambda p: p.contains("node_modules/") & ~p.rlike("node_modules/$"))
    old = docs.filter(~has_packages).select("project_id", "rel", "text")
    return flat.unionByName(map_in_pandas(old, _npm_v1, DECLARED_SCHEMA))


def _scalar(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (str, int, float)) else ""


def _range(v):
    v = v.strip()
    return bool(v) and (any(c in v for c in "^~*<>=|") or v.lower() in ("latest", "any"))


def _npm_v1(batches):
    for pdf in batches:
        out = []
        for project, rel, body in pdf[["project_id", "rel", "text"]].itertuples(index=False):
            level, depth = [json.loads(body).get("dependencies") or {}], 0
            while level:
                below = []
                for deps in level:
                    for name, entry in deps.items():
                        entry = entry if isinstance(entry, dict) else {}
                        version = _scalar(entry.get("version"))
                        out.append((project, rel, "npm", name, version, _range(version), depth == 0,
                                    _scalar(entry.get("license")) or _scalar(entry.get("licence")), 0,
                                    entry.get("dev") is True, entry.get("optional") is True, False, ""))
                        if isinstance(entry.get("dependencies"), dict):
                            below.append(entry["dependencies"])
                level, depth = below, depth + 1
        yield pd.DataFrame(out, columns=DECLARED)


def pipfile_lock(files: DataFrame) -> DataFrame:
    docs = parse_json_files(files).filter("ok")
    groups = F.array(*[F.struct(_object(F.col("doc"), f"$.{k}").alias("deps"), F.lit(k == "develop").alias("dev")) for k in ("default", "develop")])
    entries = docs.select("project_id", "rel", F.inline(groups)).select("project_id", "rel", "dev", F.explode("deps").alias("name", "entry"))
    version = F.regexp_replace(json_scalar(F.col("entry"), "$.version"), "^==", "")
    return _declared(entries, "pypi", name=F.col("name"), version=version, is_range=tx.is_range(version), dev=F.col("dev"))


def json_warnings(files: DataFrame, lockfile: bool) -> DataFrame:
    return _parse_warning(parse_json_files(files).filter(~F.col("ok")), "E-PARSE-001" if lockfile else "E-PARSE-002")


# ---- requirements.txt ------------------------------------------------------------

def lines_of(files: DataFrame) -> DataFrame:
    """(project_id, rel, line number, trimmed text)."""
    return files.select("project_id", "rel", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select(
        "project_id", "rel", (F.col("pos") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("body"))


def requirement_lines(files: DataFrame) -> DataFrame:
    """Every meaningful line with `skip` (why it is no requirement, else NULL), name, spec."""
    body = F.trim(F.split("body", ";")[0])
    body = F.trim(F.split(body, " #")[0])
    lines = lines_of(files).filter((F.col("body") != "") & ~F.col("body").startswith("#")).withColumn("body", body).filter(F.col("body") != "")
    skip = (
        F.when(F.col("body").rlike(r"^(-r|--requirement|-c|--constraint)"), "include")
        .when(F.col("body").rlike(r"^(-e|--editable|--index-url|-i|--extra-index-url|--find-links|-f)"), "directive")
        .when(F.col("body").contains("://"), "url")
    )
    plain = F.regexp_replace("body", r"^([^\[\]]*)\[[^\]]*\]", "$1")
    name = F.trim(F.regexp_extract(plain, r"^([^=<>!~]*)", 1))
    spec = F.trim(F.regexp_extract(plain, r"^[^=<>!~]*(.*)$", 1))
    return lines.select("project_id", "rel", "line", "body", skip.alias("skip"), name.alias("name"), spec.alias("spec"))


def requirements(files: DataFrame) -> DataFrame:
    r = requirement_lines(files).filter(F.col("skip").isNull() & (F.col("name") != ""))
    return _declared(r, "pypi", name=F.lower("name"), version=tx.clean_version("spec"), is_range=tx.is_range("spec"), line=F.col("line"))


def requirement_warnings(files: DataFrame) -> DataFrame:
    return requirement_lines(files).filter(F.col("skip").isNotNull()).select(
        "project_id", F.lit("E-PARSE-002").alias("code"), F.col("rel").alias("path"), "line", "skip")


# ---- go.mod ----------------------------------------------------------------------

_GO_MARKERS = ["require (", "require(", "replace (", "replace(", ")"]
_GO_BLOCK = r"(?m)(?=^[ \t]*(?:(?:require|replace) ?\(|\))[ \t\r]*$)"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _parts(text, border) -> Column:
    """A text cut before every `border`: (part, at), `at` being the line it begins on."""
    def step(state, part):
        return F.struct((state["at"] + _newlines(part)).alias("at"), F.concat(state["found"], F.array(F.struct(part.alias("part"), state["at"].alias("at")))).alias("found"))

    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<part:string,at:int>>)").alias("found"))
    return F.aggregate(F.split(text, border, -1), start, step, lambda x: x["found"])


def _cut_lines(text, border, block_of) -> Column:
    """Trimmed lines (line, body, block) of a text that is cut before every `border`;
    `block_of(part)` names the block that a part is."""
    def lines(p):
        # a part ends where the next begins, so its last piece of text is no line of its own
        return F.transform(F.split(p["part"], "\n", -1), lambda raw, i: F.struct((p["at"] + i).alias("line"), F.regexp_replace(raw, r"^\s+|\s+$", "").alias("body"), block_of(p["part"]).alias("block")))

    return F.filter(F.flatten(F.transform(_parts(text, border), lines)), lambda x: x["body"] != "")


def _go_block(part) -> Column:
    return F.when(part.rlike(r"^\s*require ?\("), "require").when(part.rlike(r"^\s*replace ?\("), "replace").otherwise("")


def _go_replacement(x) -> Column:
    body = F.when(x["block"] == "replace", x["body"]).otherwise(F.regexp_replace(x["body"], "^replace ", ""))
    left = F.split(F.trim(F.regexp_extract(body, r"^(.*?)=>", 1)), r"\s+")
    right = F.split(F.trim(F.regexp_replace(F.regexp_extract(body, r"=>(.*)$", 1), r"//.*$", "")), r"\s+")
    new = F.try_element_at(right, F.lit(1))
    local = new.rlike(r"^(\./|\.\./|\.\\|\.\.\\|/|\\|.:)")
    return F.struct(left[0].alias("old"), F.coalesce(F.try_element_at(left, F.lit(2)), F.lit("")).alias("old_version"), new.alias("path"),
                    F.when(local, "").otherwise(F.coalesce(F.try_element_at(right, F.lit(2)), F.lit(""))).alias("version"), local.alias("local"))


def _go_require(x) -> Column:
    body = F.when(x["block"] == "require", x["body"]).otherwise(F.regexp_replace(x["body"], "^require ", ""))
    words = F.split(F.trim(F.regexp_replace(body, r"//.*$", "")), r"\s+")
    return F.struct(x["line"].alias("line"), words[0].alias("name"), F.try_element_at(words, F.lit(2)).alias("version"), body.contains("// indirect").alias("indirect"))


def _last(rows, ok) -> Column:
    return F.try_element_at(F.filter(rows, ok), F.lit(-1))


def go_mod(files: DataFrame) -> DataFrame:
    """First require of each module after replacement: the last rule for the exact
    version, else the last for every version. A file is read inside its row."""
    lines = F.filter(_cut_lines("text", _GO_BLOCK, _go_block), lambda x: ~x["body"].isin(_GO_MARKERS) & ~x["body"].startswith("//"))
    rows = files.select("project_id", "rel", lines.alias("lines"))
    requires = F.transform(F.filter("lines", lambda x: (x["block"] == "require") | (x["block"] == "") & x["body"].startswith("require ")), _go_require)
    replaces = F.transform(F.filter("lines", lambda x: ((x["block"] == "replace") | x["body"].startswith("replace ")) & x["body"].contains("=>")), _go_replacement)
    rows = rows.select("project_id", "rel", F.filter(requires, lambda r: r["version"].isNotNull()).alias("requires"), F.filter(replaces, lambda r: (r["old"] != "") & (r["path"] != "")).alias("replaces"))
    names = F.transform("requires", lambda r: r["name"])
    first = F.filter("requires", lambda r, i: F.array_position(names, r["name"]) == i + 1)
    j = rows.select("project_id", "rel", "replaces", F.inline(first)).withColumn("new", F.coalesce(
        _last("replaces", lambda x: (x["old"] == F.col("name")) & (x["old_version"] == F.col("version"))), _last("replaces", lambda x: (x["old"] == F.col("name")) & (x["old_version"] == ""))))
    local = F.coalesce("new.local", F.lit(False))
    moved = F.col("new").isNotNull() & ~local
    return _declared(
        j, "go", line=F.col("line"), direct=~F.col("indirect"), local=local,
        path_dep=F.when(local, F.col("new.path")).otherwise(F.lit("")),
        name=F.when(moved, F.col("new.path")).otherwise(F.col("name")),
        version=F.when(moved & (F.col("new.version") != ""), F.col("new.version")).otherwise(F.col("version")))


def go_own_licence(files: DataFrame) -> DataFrame:
    """Licence named in a comment; the last one counts."""
    value = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("body", p, 1)), F.lit("")) for p in (
        r"(?i)license:(.*)$", r"(?i)license =(.*)$", r"(?i)licence:(.*)$", r"(?i)licence =(.*)$")])
    c = lines_of(files).filter(F.col("body").startswith("//")).select("project_id", "rel", "line", value.alias("own_licence")).filter("own_licence is not null")
    return c.groupBy("project_id", "rel").agg(F.max_by("own_licence", "line").alias("own_licence"))


# ---- [[package]] lockfiles: Cargo.lock, poetry.lock, uv.lock ----------------------

_TABLE_START = r"(?m)(?=^[ \t\r\f]*\[\[?\s*[A-Za-z])"
_PACKAGE = r"^\s*\[\s*\[\s*package\s*\]\s*\]\s*(?:\n|$)"


def _key_pattern(key):
    return rf'(?m)^[ \t]*{key}\s*=\s*"((?:[^"\\]|\\.)*)"'


def _string_key(block: Column, key) -> Column:
    return F.nullif(F.regexp_extract(block, _key_pattern(key), 1), F.lit(""))


def package_blocks(text="text") -> Column:
    """`[[package]]` tables of a lockfile: name, version, source, category, line of the
    name, and the quoted names of `dependencies`. A file is one row: its text is cut at
    the table headers and the tables are read in the row."""
    def fields(t):
        part = t["part"]
        before = F.split(part, _key_pattern("name"), 2)[0]
        listed = F.regexp_extract(part, r"(?ms)^[ \t]*dependencies\s*=\s*\[(.*?)\]", 1)
        return F.struct(
            *(_string_key(part, k).alias(k) for k in ("name", "version", "source", "category")),
            (t["at"] + _newlines(before)).alias("line"), F.regexp_extract_all(listed, F.lit(r'"([^"]+)"'), F.lit(1)).alias("listed"))

    packages = F.transform(F.filter(_parts(text, _TABLE_START), lambda t: t["part"].rlike(_PACKAGE)), fields)
    return F.filter(packages, lambda p: p["name"].isNotNull())


def locked_packages(files: DataFrame) -> DataFrame:
    # outer: for the plain form the optimizer adds a filter that reads every file once more, and where the files are not yet dealt out
    rows = files.select("project_id", "rel", F.explode_outer(package_blocks()).alias("p")).filter(F.coalesce("p.name", F.lit("")) != "")
    return rows.select("project_id", "rel", "p.name", "p.version", "p.source", "p.category", "p.line")


def cargo_lock(files: DataFrame) -> DataFrame:
    """Locked crates; direct ones are named by a source-less package, or all when none is."""
    blocks = files.select("project_id", "rel", package_blocks().alias("packages"))
    own = F.flatten(F.transform(F.filter("packages", lambda p: p["source"].isNull()), lambda p: p["listed"]))
    direct = F.array_distinct(F.transform(own, lambda d: F.regexp_replace(d, r"^(.+) [^ ]*$", "$1")))
    rows = blocks.select("project_id", "rel", direct.alias("direct_names"), F.explode("packages").alias("p")).select("project_id", "rel", "direct_names", "p.*")
    return _declared(rows, "cargo", name=F.col("name"), version=F.coalesce("version", F.lit("")), line=F.col("line"), local=F.col("source").isNull(),
                     direct=(F.size("direct_names") == 0) | F.array_contains("direct_names", F.col("name")))


def poetry_lock(files: DataFrame) -> DataFrame:
    pk = locked_packages(files)
    version = F.coalesce("version", F.lit(""))
    return _declared(pk, "pypi", name=F.lower("name"), version=version, is_range=tx.is_range(version), line=F.lit(0),
                     dev=F.coalesce(F.lower("category") == "dev", F.lit(False)))


# ---- TOML manifests ----------------------------------------------------------------

def _clean(v):
    v = v.strip().removeprefix("^").removeprefix("~").split(",")[0]
    return v.lstrip("=<>!~^ ").strip()


def _split_requirement(s):
    s = s.strip()
    i, j = s.find("["), s.find("]")
    if 0 <= i < j:
        s = s[:i] + s[j + 1:]
    cut = min([k for k in (s.find(c) for c in "=<>!~") if k >= 0], default=len(s))
    return s[:cut].strip(), s[cut:].strip()


def _pyproject_rows(doc):
    project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
    for key, optional in (("dependencies", False), ("optional-dependencies", True)):
        specs = project.get(key)
        for spec in specs if isinstance(specs, list) else []:
            name, version = _split_requirement(spec) if isinstance(spec, str) else ("", "")
            if name:
                yield name.lower(), version, False, optional
    for key, dev in (("dependencies", False), ("dev-dependencies", True)):
        for name, spec in (poetry.get(key) or {}).items():
            if not dev and name.lower() == "python":
                continue
            if isinstance(spec, dict):
                spec = "" if dev else spec.get("version", "")
            yield name.lower(), spec if isinstance(spec, str) else "", dev, False


def _pyproject(batches):
    for pdf in batches:
        out = []
        for project, rel, body in pdf[["project_id", "rel", "text"]].itertuples(index=False):
            try:
                rows = list(_pyproject_rows(tomllib.loads(body)))
            except (tomllib.TOMLDecodeError, AttributeError):
                rows = []
            out += [(project, rel, "pypi", n, _clean(v), _range(v), True, "", 0, dev, opt, False, "") for n, v, dev, opt in rows]
        yield pd.DataFrame(out, columns=DECLARED)


def pyproject(files: DataFrame) -> DataFrame:
    return map_in_pandas(files.select("project_id", "rel", "text"), _pyproject, DECLARED_SCHEMA)


def _dependency_tables(doc):
    """The dependency tables of a Cargo manifest, also below `target` and `workspace`."""
    for key, value in doc.items():
        if isinstance(value, dict):
            if key in ("dependencies", "dev-dependencies", "build-dependencies"):
                yield key, value
            else:
                yield from _dependency_tables(value)


def _cargo_toml(batches):
    for pdf in batches:
        out = []
        for project, rel, body in pdf[["project_id", "rel", "text"]].itertuples(index=False):
            try:
                tables = list(_dependency_tables(tomllib.loads(body)))
            except tomllib.TOMLDecodeError:
                continue
            found = {}
            for table, deps in tables:
                for name, spec in deps.items():
                    e = found.setdefault(name, {"version": "", "range": False, "path": "", "optional": False, "dev": False})
                    e["dev"] = table == "dev-dependencies"
                    spec = {"version": spec} if isinstance(spec, str) else spec if isinstance(spec, dict) else {}
                    if isinstance(spec.get("version"), str):
                        e["version"], e["range"] = _clean(spec["version"]), True
                    e["path"] = spec.get("path", e["path"])
                    e["optional"] = spec.get("optional", e["optional"])
            for name, e in sorted(found.items()):
                out.append((project, rel, "cargo", name, e["version"], e["range"], True, "", 0, e["dev"], e["optional"], bool(e["path"]), e["path"]))
        yield pd.DataFrame(out, columns=DECLARED)


def cargo_toml(files: DataFrame) -> DataFrame:
    return map_in_pandas(files.select("project_id", "rel", "text"), _cargo_toml, DECLARED_SCHEMA)


def _toml_own(batches):
    for pdf in batches:
        out = []
        for project, rel, body in pdf[["project_id", "rel", "text"]].itertuples(index=False):
            try:
                doc, own, bad = tomllib.loads(body), "", False
            except tomllib.TOMLDecodeError:
                doc, own, bad = {}, "", True
            places = [doc.get("package"), doc.get("project"), (doc.get("tool") or {}).get("poetry")]
            for place in [p for p in places if isinstance(p, dict)]:
                value = place.get("license") or place.get("licence") or ""
                value = value.get("text", "") if isinstance(value, dict) else value
                own = own or (value if isinstance(value, str) else "")
            out.append((project, rel, own, bad))
        yield pd.DataFrame(out, columns=["project_id", "rel", "own_licence", "malformed"])


def toml_own_licence(files: DataFrame) -> DataFrame:
    """(project_id, rel, own_licence, malformed)."""
    return map_in_pandas(files.select("project_id", "rel", "text"), 
        _toml_own, "project_id string, rel string, own_licence string, malformed boolean")


# ---- all together --------------------------------------------------------------------

READERS = {
    "package.json": npm_manifest, "package-lock.json": npm_lock, "npm-shrinkwrap.json": npm_lock,
    "requirements.txt": requirements, "requirements-dev.txt": requirements, "pyproject.toml": pyproject,
    "poetry.lock": poetry_lock, "uv.lock": poetry_lock, "Pipfile.lock": pipfile_lock, "go.mod": go_mod,
    "Cargo.toml": cargo_toml, "Cargo.lock": cargo_lock,
}


def read_declared(files: DataFrame) -> DataFrame:
    """Declared rows of every known manifest and lockfile among (project_id, rel, text)."""
    base = files.withColumn("_base", tx.base_name("rel"))
    out = None
    for reader in dict.fromkeys(READERS.values()):
        names = [n for n, r in READERS.items() if r is reader]
        part = reader(base.filter(F.col("_base").isin(names)).drop("_base"))
        out = part if out is None else out.unionByName(part)
    return out


def chosen_declarations(units: DataFrame, declared: DataFrame) -> DataFrame:
    """Per unit the lockfile's rows when it yielded any, else the manifest's.

    Adds dir, source (`lockfile`/`manifest`) and merges the manifest's directness
    into locked rows.
    """
    m = units.select("project_id", "dir", "ecosystem", F.col("manifest").alias("source_path"), F.lit("manifest").alias("source"))
    k = units.select("project_id", "dir", "ecosystem", F.col("lockfile").alias("source_path"), F.lit("lockfile").alias("source"))
    roles = m.unionByName(k).filter(F.col("source_path").isNotNull())
    rows = declared.join(roles, ["project_id", "ecosystem", "source_path"])
    locked = rows.filter(F.col("source") == "lockfile").groupBy("project_id", "dir", "ecosystem").agg(F.lit(True).alias("_locked"))
    rows = fact_join(rows, locked, ["project_id", "dir", "ecosystem"])
    direct = (
        rows.filter((F.col("source") == "manifest") & F.col("direct"))
        .select("project_id", "dir", "ecosystem", "name").distinct().withColumn("_direct", F.lit(True))
    )
    use = (F.col("source") == "lockfile") | F.col("_locked").isNull()
    return (
        rows.filter(use).join(direct, ["project_id", "dir", "ecosystem", "name"], "left")
        .withColumn("direct", F.col("direct") | F.coalesce("_direct", F.lit(False))).drop("_direct", "_locked")
    )


def fallback_warnings(units: DataFrame, declared: DataFrame) -> DataFrame:
    """Units whose lockfile yielded nothing: the manifest's requirements stand in."""
    read = declared.select("project_id", F.col("source_path").alias("lockfile")).distinct()
    return units.filter(F.col("lockfile").isNotNull()).join(read, ["project_id", "lockfile"], "left_anti").select(
        "project_id", F.lit("E-PARSE-001").alias("code"), F.col("lockfile").alias("path"))


def own_licence(candidates: DataFrame) -> DataFrame:
    """(project_id, ordinal, own_licence) -> first statement of each project."""
    c = candidates.filter(F.coalesce("own_licence", F.lit("")) != "")
    return c.groupBy("project_id").agg(F.min_by("own_licence", "ordinal").alias("own_licence"))
