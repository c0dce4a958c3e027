"""File inventory and manifest queries on files derived from line items and parts."""

from pyspark.sql import functions as F

from lexfleet.functions import text as tx
from lexfleet.operators import graph, ownership as own
from lexfleet.operators.ranking import ordinal_within
from lexfleet.plans import bindings as b
from lexfleet.plans.registry import query
from lexfleet.session import pinned
from lexfleet.sources import assets, files as fs, manifests as mf

TOPS = ["src", "vendor", "node_modules", ".git", "docs/a", "app/dist", "lib/venv"]
NAMES = ["LICENSE", "package.json", "package-lock.json", "Cargo.toml", "README.md", "pyvenv.cfg", "go.mod",
         "requirements.txt", "poetry.lock", "yarn.lock", "pyproject.toml"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def files(spark, sf):
    """One file per (order, part): its directory and name follow from the line."""
    from lexfleet.operators.graph import upsert

    li = upsert(b.line_items(spark, sf), keys=("l_orderkey", "l_partkey"))
    name = F.col("l_partkey").cast("string")
    return li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"),
        F.concat_ws("/", _pick(TOPS, F.col("l_linenumber") % len(TOPS)),
                    F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), (F.col("l_partkey") % 2).cast("string"))),
                    F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("@acme/lib"), (F.col("l_suppkey") % 2).cast("string"))),
                    F.when(F.col("l_partkey") % 7 == 0, F.lit("node_modules")),
                    F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("x"), name)),
                    _pick(NAMES, (F.col("l_suppkey") + F.col("l_linenumber")) % len(NAMES))).alias("rel"),
        (F.col("l_partkey") * 5000).alias("length"), F.col("l_shipdate").alias("modification_time")).groupBy("project_id", "rel").agg(
        F.max("length").alias("length"), F.max("modification_time").alias("modification_time"))


@query
def path_prune(spark, sf):
    return fs.prune(files(spark, sf)).select("project_id", "rel")


@query
def unit_discovery(spark, sf):
    u = fs.discover_units(files(spark, sf))
    return u.select("project_id", "dir", "ecosystem", "manifest", "lockfile", F.array_join("unsupported_lockfiles", ",").alias("unsupported"))


@query
def scan_statistics(spark, sf):
    f = fs.within_limits(files(spark, sf), max_bytes=4_000_000, max_depth=4)
    s = fs.scan_stats(f)
    warned = fs.over_limit_warnings(f).unionByName(fs.depth_warnings(f)).groupBy("project_id").agg(
        F.count_if(F.col("code") == "E-SCAN-006").alias("over"), F.count_if(F.col("code") == "E-SCAN-008").alias("deep"))
    zero = F.lit(0).cast("long")
    return s.join(warned, "project_id", "left").select("project_id", "files_seen", "bytes_seen", "max_depth", F.coalesce("over", zero).alias("over_limit"), F.coalesce("deep", zero).alias("too_deep"))


@query
def walk_truncation(spark, sf):
    """All files; which projects have over four, and which files are not the first four."""
    return fs.truncate(files(spark, sf), max_files=4).select("project_id", "rel", "truncated", "beyond")


@query
def byte_budgets(spark, sf):
    return fs.byte_budget(files(spark, sf), 9_000_000).select("project_id", "rel", "over_budget")


def ignore_rules(spark, sf, of=None):
    """Three hand-written rules for every project of the files."""
    p = (files(spark, sf) if of is None else of).select("project_id").distinct()
    rules = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(r).alias("path")) for i, r in enumerate(["src/**", "docs/a/*", "vendor/LICENSE"])])
    return p.select("project_id", F.inline(rules))


@query
def ignored_files(spark, sf):
    return fs.match_ignores(files(spark, sf), ignore_rules(spark, sf))


@query
def ignore_share(spark, sf):
    return fs.ignore_share(fs.mark_ignores(files(spark, sf), ignore_rules(spark, sf)))


@query
def ignore_patterns(spark, sf):
    """Rules with wildcards in the middle, at the start and inside segments."""
    p = files(spark, sf).select("project_id").distinct()
    paths = ["**/node_modules/**", "src/**/LICENSE", "docs/*/p?/*.json", "**/*.lock", "app/dist/**"]
    rules = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(r).alias("path")) for i, r in enumerate(paths)])
    return fs.match_ignores(files(spark, sf), p.select("project_id", F.inline(rules)), wildcards=True)


@query
def warning_order(spark, sf):
    """Warnings of a scan, numbered in the order in which a report lists them."""
    f = pinned(files(spark, sf).select("project_id", "rel", "length").repartition("project_id"))  # read by both warnings, their numbering and the rules
    marked = fs.mark_ignores(fs.within_limits(f), ignore_rules(spark, sf, f))
    rows = fs.over_limit_warnings(marked).unionByName(fs.ignore_warnings(marked)).withColumn("message", F.lit(""))
    return graph.in_order(rows, graph.WARNING_ORDER).select("project_id", "position", "code", "path")


@query
def stale_lockfiles(spark, sf):
    f = files(spark, sf)
    return fs.stale_lockfiles(fs.discover_units(f), f).select("project_id", "manifest", "lockfile", "code")


@query
def longest_prefix_owner(spark, sf):
    """Files inside dependency trees, their scope and the package that owns them."""
    f = b.shared(files(spark, sf))
    units = fs.discover_units(f)
    inside = own.containing_scope(f.filter(fs.inside_dependency_dir()).select("project_id", "rel"), units)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("scope")) for n, s in (
        ("p0", "."), ("p0/@acme/lib0", "."), ("@acme/lib1", "lib/venv"), ("@acme", "."), ("node_modules", "."), ("p1", "src"))])
    packages = f.select("project_id").distinct().select("project_id", F.inline(names)).select(
        "project_id", "name", "scope", F.lit("package").alias("kind"), F.concat(F.lit("npm:"), "name").alias("id"))
    owners = own.owner_of(inside, packages)
    return inside.join(owners, ["project_id", "rel"], "left").select("project_id", "rel", "scope", "owner_id")


@query
def brand_assets(spark, sf):
    """Brand files, folders and trademark notices inside every part's dependency tree,
    the strongest signal of each directory as an asset of its unit."""
    p = b.spread(b.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("project_id"), F.col("p_partkey").cast("string").alias("k")), "project_id")
    at = lambda *x: F.concat(*[F.col(v[1:]) if v.startswith("$") else F.lit(v) for v in x])
    rows = [
        (at("app/package.json"), F.lit(None)), (at("app/node_modules/m", "$k", "/Logo.svg"), F.lit(None)), (at("app/node_modules/m", "$k", "/TRADEMARKS.md"), at("first\nwords ", "$k")),
        (at("node_modules/n/brand/x", "$k", ".png"), F.lit(None)), (at("node_modules/n/brand/icon.png"), F.lit(None)), (at("src/logo.svg"), F.lit(None)), (at("node_modules/o/.icon"), F.lit(None)),
    ]
    cells = F.array(*[F.struct(r.alias("rel"), t.cast("string").alias("text")) for r, t in rows])
    f = p.select("project_id", F.inline(cells)).withColumn("length", F.lit(1))
    found = assets.asset_dependencies(assets.asset_signals(f.select("project_id", "rel", "text")), fs.discover_units(f))
    return found.select("project_id", "id", "name", "scope", "licence_confidence", "evidence_path", "signal")


# ---- manifests: text made from every part ---------------------------------------------

def part_texts(spark, sf, text):
    p = b.spread(b.table(spark, sf, "part"), "p_partkey").select("*", F.regexp_replace("p_name", " ", "-").alias("n"), F.col("p_partkey").cast("string").alias("k"),
                                                                 F.col("p_size").cast("string").alias("v"))
    return p.select(F.concat(F.lit("p"), "k").alias("project_id"), F.lit("m").alias("rel"), text.alias("text"))


def _lines(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("$") else F.col(x[1:]) for x in parts])


@query
def requirements_lines(spark, sf):
    text = _lines("# pins\n", "$n", "==", "$v", ".1 ; python_version > '3'\n\nLib-", "$k", "[extra,more] >=", "$v", ", <99\n  -r other.txt\n",
                  "Plain", "$k", " # why\n-e .\nhttps://x.test/a-", "$k", ".whl\nTilde", "$k", "~=2.", "$v", "\nany", "$k", "==*")
    t = part_texts(spark, sf, text)
    return mf.requirements(t).select("project_id", "name", "version", "is_range", "line")


@query
def declared_order(spark, sf):
    """Position of every declaration in the order in which reports list them."""
    text = _lines("b", "$k", "==2.0\na-", "$n", "==1.0\nb", "$k", "==10.0\nzz>=1\na", "$v", "\n")
    d = mf.requirements(part_texts(spark, sf, text))
    placed = ordinal_within(d, ["project_id"], [*graph.DECLARED_ORDER, "line"], "position")
    return placed.select("project_id", F.col("position").cast("long").alias("position"), "name", "version")


@query
def requirements_warnings(spark, sf):
    text = _lines("-r a", "$k", ".txt\n--index-url https://x.test\n", "$n", "\ngit+https://x.test/", "$k")
    return mf.requirement_warnings(part_texts(spark, sf, text)).select("project_id", "code", "line", "skip")


@query
def go_mod_blocks(spark, sf):
    text = _lines("module m/", "$k", "\n// license: MIT\ngo 1.22\nrequire (\n\tx.test/", "$n", " v1.", "$v", ".0\n\tx.test/ind v0.", "$k", ".0 // indirect\n)\n",
                  "require x.test/single v2.0.", "$k", "\nrequire x.test/", "$n", " v9.9.9\nrequire x.test/loc v1.0.0\nreplace (\n\tx.test/", "$n", " => y.test/fork v3.", "$v",
                  ".0\n\tx.test/ind v0.", "$k", ".0 => z.test/exact\n)\nreplace x.test/ind => z.test/any v5.0.0\nreplace x.test/loc => ../loc", "$k", "\n")
    return mf.go_mod(part_texts(spark, sf, text)).select("project_id", "name", "version", "direct", "local", "path_dep", "line")


@query
def npm_groups(spark, sf):
    text = _lines('{"name":"m","licenses":[{"type":"ISC"}],"dependencies":{"@s/', "$n", '":"^', "$v", '.0.0","odd":7},"devDependencies":{"d', "$k",
                  '":"', "$v", '.2"},"peerDependencies":{"p":">=1 <2"},"optionalDependencies":{"o', "$k", '":"latest"}}')
    return mf.npm_manifest(part_texts(spark, sf, text)).select("project_id", "name", "version", "is_range", "dev", "optional")


@query
def npm_lock_packages(spark, sf):
    text = _lines('{"lockfileVersion":3,"packages":{"":{"version":"0"},"node_modules/', "$n", '":{"version":"', "$v", '.0.0","license":"MIT"},"node_modules/a/node_modules/@s/b',
                  "$k", '/":{"version":"2","licence":"ISC","dev":true},"packages/own":{"version":"1"}}}')
    return mf.npm_lock(part_texts(spark, sf, text)).select("project_id", "name", "version", "direct", "licence_raw", "dev")


@query
def npm_lock_nested(spark, sf):
    text = _lines('{"lockfileVersion":1,"dependencies":{"top', "$k", '":{"version":"', "$v", '.0.0","dependencies":{"mid":{"version":"^1","optional":true,"dependencies":{"leaf',
                  "$k", '":{"version":"3","license":"MIT"}}}}}}}')
    return mf.npm_lock(part_texts(spark, sf, text)).select("project_id", "name", "version", "is_range", "direct", "licence_raw", "optional")


@query
def pipfile_locks(spark, sf):
    text = _lines('{"default":{"', "$n", '":{"version":"==', "$v", '.0"}},"develop":{"dev', "$k", '":{"version":"*"}}}')
    return mf.pipfile_lock(part_texts(spark, sf, text)).select("project_id", "name", "version", "is_range", "dev")


@query
def cargo_lock_blocks(spark, sf):
    text = _lines('version = 3\n\n[[package]]\nname = "app', "$k", '"\nversion = "0.1.0"\ndependencies = [\n "serde 1.', "$v", '",\n "', "$n",
                  '",\n]\n\n[[package]]\nname = "serde"\nversion = "1.', "$v", '"\nsource = "registry"\ndependencies = ["deep', "$k", '"]\n\n[[package]]\nname = "',
                  "$n", '"\nversion = "', "$v", '.0.0"\nsource = "registry"\n\n[[package]]\nname = "deep', "$k", '"\nversion = "2.0.0"\nsource = "registry"\n\n[metadata]\nname = "not a package"\n')
    return mf.cargo_lock(part_texts(spark, sf, text)).select("project_id", "name", "version", "direct", "local", "line")


@query
def poetry_locks(spark, sf):
    text = _lines('[[package]]\nname = "Pkg', "$k", '"\nversion = "', "$v", '.0"\ncategory = "dev"\n\n[package.dependencies]\nname = ">=1"\n\n[[package]]\nname = "', "$n", '"\nversion = "1.0"\n')
    return mf.poetry_lock(part_texts(spark, sf, text)).select("project_id", "name", "version", "dev")


@query
def pyproject_tables(spark, sf):
    text = _lines('[project]\nname = "m"\nlicense = {text = "MIT"}\ndependencies = ["', "$n", ">=", "$v", '", "Extra', "$k", '[x]~=1.0"]\n\n[tool.poetry.dependencies]\npython = "^3.11"\nPoem',
                  "$k", ' = "^', "$v", '.1"\ntbl = {version = "2.*", optional = true}\n\n[tool.poetry.dev-dependencies]\nqa = "', "$v", '.0"\n')
    return mf.pyproject(part_texts(spark, sf, text)).select("project_id", "name", "version", "is_range", "dev")


@query
def cargo_tables(spark, sf):
    text = _lines('[package]\nname = "m"\nlicense = "MIT"\n\n[dependencies]\n', "$n", ' = "', "$v", '.0"\nloc = { path = "../loc', "$k", '" }\n\n[dev-dependencies]\nt', "$k",
                  " = { version = \"^1.2\", optional = true }\n\n[target.'cfg(unix)'.dependencies.deep]\nversion = \"~3\"\n")
    return mf.cargo_toml(part_texts(spark, sf, text)).select("project_id", "name", "version", "is_range", "dev", "optional", "local", "path_dep")


@query
def own_licences(spark, sf):
    """A project's own licence: the manifest's statement first, else the root text."""
    p = b.parts(spark, sf)
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("project_id")
    manifest = p.select(key, F.lit(0).alias("ordinal"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("licence_raw")).alias("own_licence"))
    root = p.select(key, F.lit(1).alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, F.lit("MIT")).alias("own_licence"))
    return mf.own_licence(manifest.unionByName(root))


def _unit_declarations(spark, sf):
    """Manifest rows of every part and lockfile rows of most: (units, declared)."""
    p = b.parts(spark, sf)
    base = p.select(F.concat(F.lit("u"), "version").alias("project_id"), "p_partkey", "ecosystem", "name", "version", "licence_raw")
    units = base.select("project_id", "ecosystem").distinct().select(
        "project_id", F.lit("app").alias("dir"), "ecosystem", F.lit("app/manifest").alias("manifest"), F.lit("app/lock").alias("lockfile"))
    common = dict(is_range=F.lit(False), line=F.lit(0), dev=F.lit(False), optional=F.lit(False), local=F.lit(False), path_dep=F.lit(""))

    def rows(df, path, version, direct):
        cols = {"project_id": F.col("project_id"), "source_path": F.lit(path), "ecosystem": F.col("ecosystem"), "name": F.col("name"),
                "version": version, "direct": direct, "licence_raw": F.col("licence_raw"), **common}
        return df.select(*[cols[c].alias(c) for c in mf.DECLARED])

    manifest = rows(base, "app/manifest", F.lit("1.0"), F.col("p_partkey") % 2 == 0)
    lock = rows(base.filter(~F.col("version").startswith("1")), "app/lock", F.col("version"), F.lit(False))
    return units, manifest.unionByName(lock)


@query
def lockfile_precedence(spark, sf):
    units, declared = _unit_declarations(spark, sf)
    return mf.chosen_declarations(units, declared).select("project_id", "ecosystem", "name", "version", "source", "direct")


@query
def fallback_warnings(spark, sf):
    units, declared = _unit_declarations(spark, sf)
    return mf.fallback_warnings(units, declared).select("project_id", "code", "path")


@query
def declared_dependencies(spark, sf):
    """Declarations as dependency rows; local paths are kept only outside the root."""
    units, declared = _unit_declarations(spark, sf)
    chosen = mf.chosen_declarations(units, declared)
    k = F.length("name")
    local = k % 4 == 0
    chosen = chosen.withColumn("local", local).withColumn("path_dep", F.when(local & (k % 8 == 0), F.lit("../../out")).when(local, F.lit("../lib/./x")).otherwise(F.lit("")))
    return graph.to_dependencies(chosen).select("project_id", "id", "scope", "direct", "spdx", "resolved", "licence_source",
                                                F.coalesce(F.try_element_at("metadata", F.lit("path")), F.lit("")).alias("path"),
                                                F.size("metadata").alias("entries"))


@query
def vendored_attach(spark, sf):
    """Licence texts in dependency trees: fill, stand next to, or stand alone."""
    f = files(spark, sf).filter(fs.inside_dependency_dir() & tx.is_licence_file_name(tx.base_name("rel"))).select("project_id", "rel")
    texts = f.withColumn("scope", F.lit(".")).withColumn(
        "text_spdx", F.when(F.length("rel") % 4 != 0, F.when(F.length("rel") % 3 == 0, "MIT").otherwise("GPL-3.0-only")))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("spdx")) for n, s in (("p0", ""), ("p1", "Apache-2.0"), ("@acme", ""))])
    deps = f.select("project_id").distinct().select("project_id", F.inline(names)).select(
        "project_id", F.concat(F.lit("npm:"), "name").alias("id"), F.lit("package").alias("kind"), "name", F.lit("").alias("version"),
        F.lit("npm").alias("ecosystem"), F.lit(".").alias("scope"), F.lit(True).alias("direct"), "spdx", F.col("spdx").alias("raw"),
        F.lit("manifest").alias("licence_source"), F.lit(False).alias("expression"), (F.col("spdx") != "").alias("resolved"),
        F.lit("high").alias("licence_confidence"), F.lit(None).cast("string").alias("declared_licence"),
        F.lit("package.json").alias("evidence_path"), F.lit(0).alias("evidence_line"))
    return own.attach_vendored(texts, deps).select("project_id", "id", "kind", "name", "spdx", "licence_source", "resolved", "declared_licence")
