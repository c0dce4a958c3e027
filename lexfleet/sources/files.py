"""File inventories: listing, pruning, budgets, ignore rules, project units.

A file row is (project_id, rel, length, modification_time[, content]).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexfleet.functions import fixed, text
from lexfleet.operators.ranking import ordinal_within, running_total
from lexfleet.session import local_frame, map_in_pandas, fact_join, small_side

HELD_BYTES = 16 << 20
FILE_COLUMNS = ["project_id", "rel", "length", "modification_time"]


def list_files(spark: SparkSession, root: str, with_content=False, glob=None, max_bytes=None) -> DataFrame:
    """Files under `root/<project>/…`. Without content nothing but the listing is read;
    `max_bytes` and a modification filter are pushed into the reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.regexp_extract("path", r"^[a-z0-9]+:/+(.*)$", 1)
    rel = F.substr(inner, F.lit(len(base) + 2))
    out = df.select(
        F.split(rel, "/", 2)[0].alias("project_id"), F.split(rel, "/", 2)[1].alias("rel"),
        "length", F.col("modificationTime").alias("modification_time"), "path", *(["content"] if with_content else []))
    return out.filter(F.col("rel").isNotNull())


def open_path(path: str):
    """A random-access file by URI or local path (runs inside tasks)."""
    from pyarrow import fs

    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _read(batches):
    """Texts leave the task whenever HELD_BYTES have been read: a batch holds paths, and
    all its files together may be far larger than a worker."""
    for pdf in batches:
        start, texts, held = 0, [], 0
        for i, path in enumerate(pdf["path"]):
            with open_path(path) as f:
                body = f.read()
            texts.append(body.decode("utf-8", "replace"))
            held += len(body)
            if held >= HELD_BYTES or i + 1 == len(pdf):
                yield pdf.iloc[start : i + 1][["project_id", "rel", "length"]].assign(text=texts)
                start, texts, held = i + 1, [], 0


def read_texts(files: DataFrame, partitions=None) -> DataFrame:
    """Whole text of the listed files, whatever their size.

    Which files to open is decided on the listing, so nothing else is read; the
    paths are spread evenly because listings come in few partitions.
    """
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = files.select("project_id", "rel", "length", "path")
    return map_in_pandas(todo.repartition(n, "path"), _read, "project_id string, rel string, length long, text string")


# ---- pruning -----------------------------------------------------------------

def _alternatives(names):
    return "|".join(n.replace(".", r"\.") for n in names)


PRUNED_DIRS = (
    r"(?:^|/)(?:" + _alternatives(fixed.SKIP_DIRS + fixed.BUILD_DIRS) + r")/"
    r"|node_modules/(?:.*/)?\.cache/"
    r"|node_modules.*/node_modules/"
)
VENV_NAME = r"(?:^|/)(?:" + _alternatives(fixed.VENV_DIRS) + r")/"
VENV_MARKER = r"^((?:.*/)?(?:" + _alternatives(fixed.VENV_DIRS) + r"))/(?:pyvenv\.cfg$|Scripts(?:/|$)|bin/activate$|lib/python3(?:/|$))"


def prune(files: DataFrame) -> DataFrame:
    """Drop generated, version-control, nested-module and virtualenv directories.

    Only files below a directory that is named like a virtualenv go through the
    anti-join; everything else passes on a path test alone.
    """
    kept = files.filter(~F.col("rel").rlike(PRUNED_DIRS))
    venvs = (
        kept.select("project_id", F.regexp_extract("rel", VENV_MARKER, 1).alias("_dir"))
        .filter(F.col("_dir") != "").distinct()
    )
    suspect = kept.filter(F.col("rel").rlike(VENV_NAME))
    inside = (
        suspect.select("project_id", "rel", F.explode(text.path_prefixes("rel")).alias("_dir"))
        .join(venvs, ["project_id", "_dir"], "left_semi").select("project_id", "rel").distinct()
    )
    cleared = suspect.join(inside, ["project_id", "rel"], "left_anti")
    return kept.filter(~F.col("rel").rlike(VENV_NAME)).unionByName(cleared)


def depth(rel="rel") -> Column:
    return F.size(F.split(text.col(rel), "/"))


def in_dependency_dir(rel: str) -> bool:
    """The same test for one path, inside a task."""
    return not set(fixed.DEPENDENCY_DIRS).isdisjoint(rel.replace("\\", "/").split("/"))


def inside_dependency_dir(rel="rel") -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(text.col(rel), r"\\", "/"), F.lit("/")).rlike(
        "/(?:" + _alternatives(fixed.DEPENDENCY_DIRS) + ")/")


# ---- budgets -----------------------------------------------------------------

def within_limits(files: DataFrame, max_bytes=fixed.MAX_FILE_BYTES, max_depth=fixed.MAX_DEPTH) -> DataFrame:
    """Adds over_limit and too_deep, which name a file in a warning. No file is dropped."""
    return files.withColumn("over_limit", F.col("length") > max_bytes).withColumn("too_deep", depth() > max_depth + 1)


def over_limit_warnings(files: DataFrame) -> DataFrame:
    return files.filter("over_limit").select("project_id", F.lit("E-SCAN-006").alias("code"), F.col("rel").alias("path"))


def depth_warnings(files: DataFrame) -> DataFrame:
    return files.filter("too_deep").select("project_id", F.lit("E-SCAN-008").alias("code"), F.col("rel").alias("path"))


def truncate(files: DataFrame, max_files=fixed.MAX_FILES) -> DataFrame:
    """All files, with two flags: truncated, when the project has more than `max_files`,
    and beyond, when the file is not among the first that many paths.

    Projects within the budget are told apart by a plain count; only the ones
    beyond it are numbered.
    """
    sizes = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    over = sizes.filter(F.col("_n") > max_files).select("project_id")
    fits = files.join(over, "project_id", "left_anti").withColumn("truncated", F.lit(False)).withColumn("beyond", F.lit(False))
    ranked = ordinal_within(files.join(over, "project_id", "left_semi"), ["project_id"], ["rel"], "_pos")
    return fits.unionByName(ranked.withColumn("truncated", F.lit(True)).withColumn("beyond", F.col("_pos") > max_files).drop("_pos"))


def byte_budget(files: DataFrame, max_total: int) -> DataFrame:
    """Adds over_budget: the running size in path order has passed the project's total."""
    return running_total(files, ["project_id"], ["rel"], "length", "_sum").withColumn(
        "over_budget", F.col("_sum") > max_total).drop("_sum")


def scan_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files_seen"), F.sum("length").alias("bytes_seen"),
        F.max(depth() - 1).alias("max_depth"))


# ---- ignore rules ------------------------------------------------------------

WILD = "[*?]"


def path_pattern(path) -> Column:
    """A rule's path as a regular expression: `**` stands for any number of whole segments,
    `*` and `?` for characters inside one; one that ends in `/**` means a place and all below."""
    c = F.regexp_replace(text.col(path), r"([.+^$(){}|\[\]\\])", r"\\$1")
    c = F.regexp_replace(F.regexp_replace(c, r"/\*\*$", "\u0001"), r"(^|/)(?:\*\*/)+", "$1\u0002")
    for wild, meaning in ((r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:/.+)?"), ("\u0002", "(?:[^/]+/)*")):
        c = F.regexp_replace(c, wild, meaning)
    return F.concat(F.lit("^"), c, F.lit("$"))


def ignore_keys(rules: DataFrame, wildcards=False) -> DataFrame:
    """(project_id, ordinal, path) -> equi-join keys. A path, `path/*` and `path/**` are the
    forms of a rule; only with `wildcards` a star elsewhere is more than a character, since
    such rules hide what a reader does not see at once. A rule without inner wildcards is found
    by a path, a directory or a prefix; any other by its longest segment without one, and
    only where it has none by the project alone. Those two forms are tested by `pattern`."""
    p = F.regexp_replace(F.trim("path"), r"\\", "/")
    stem = F.regexp_replace(p, r"/\*\*?$", "")
    plain = F.filter(F.split(stem, "/"), lambda s: (s != "") & ~s.rlike(WILD))
    longest = F.array_max(F.transform(plain, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    wild = stem.rlike(WILD) if wildcards else F.lit(False)
    form = F.when(wild & longest.isNotNull(), "segment").when(wild, "any").when(p.endswith("/**"), "tree").when(p.endswith("/*"), "children").otherwise("exact")
    key = F.when(wild, F.coalesce(longest, F.lit(""))).otherwise(stem)
    return rules.filter(p != "").select("project_id", "ordinal", F.col("path").alias("rule_path"), form.alias("form"), key.alias("key"), F.when(wild, path_pattern(p)).alias("pattern"))


RULES_IN_ROW = 64  # rules of a project that are tried one by one at every file


def _first_in_row(rel: Column, rules: Column) -> Column:
    """Path of the first rule (by ordinal) of an array of rules that names the file, or null."""
    folder, inside = text.dir_name(rel), F.concat(F.lit("/"), rel, F.lit("/"))
    place = lambda r: (
        F.when(r["form"] == "exact", r["key"] == rel).when(r["form"] == "children", r["key"] == folder)
        .when(r["form"] == "tree", (r["key"] == rel) | F.startswith(rel, F.concat(r["key"], F.lit("/"))))
        .when(r["form"] == "segment", F.contains(inside, F.concat(F.lit("/"), r["key"], F.lit("/")))).otherwise(F.lit(True)))
    hits = F.filter(rules, lambda r: place(r) & (r["pattern"].isNull() | F.regexp_like(rel, r["pattern"])))
    return F.array_min(F.transform(hits, lambda r: F.struct(r["ordinal"], r["rule_path"])))["rule_path"]


def _with_rules(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files with `_rules`, the rules of their project (a document names them, so a row holds them)."""
    lists = keys.groupBy("project_id").agg(F.collect_list(F.struct("ordinal", "rule_path", "form", "key", "pattern")).alias("_rules"))
    return fact_join(files, lists, "project_id", "left")


def _first_by_key(files: DataFrame, keys: DataFrame, wildcards: bool) -> DataFrame:
    """The same for any number of rules: every place that could name a file is looked up."""
    cell = lambda form, key: F.struct(F.lit(form).alias("form"), key.alias("key"))
    rel = F.regexp_replace("rel", r"\\", "/")
    cells = F.concat(
        F.array(cell("exact", rel), cell("children", text.dir_name("rel")), *([cell("any", F.lit(""))] if wildcards else [])),
        F.transform(text.path_prefixes(rel), lambda k: cell("tree", k)),
        *([F.transform(F.array_distinct(F.split(rel, "/")), lambda k: cell("segment", k))] if wildcards else []))
    probes = files.select("project_id", "rel", rel.alias("_rel"), F.explode(cells).alias("_c")).select("project_id", "rel", "_rel", "_c.*")
    hits = fact_join(probes, keys, ["project_id", "form", "key"], "inner")
    hits = hits.filter(F.col("pattern").isNull() | F.regexp_like("_rel", F.col("pattern")))
    return hits.groupBy("project_id", "rel").agg(F.min_by("rule_path", "ordinal").alias("rule_path"))


def match_ignores(files: DataFrame, rules: DataFrame, wildcards=False) -> DataFrame:
    """Ignored files with the first rule (by ordinal) that names them."""
    return mark_ignores(files.select("project_id", "rel").distinct(), rules, wildcards).filter(
        F.col("ignored_by").isNotNull()).select("project_id", "rel", F.col("ignored_by").alias("rule_path"))


def mark_ignores(files: DataFrame, rules: DataFrame, wildcards=False) -> DataFrame:
    """All files with `ignored_by`, the rule that hides them or null. A file crosses one shuffle
    and is one row there; only projects with more than RULES_IN_ROW rules are looked up by key."""
    keys = ignore_keys(rules, wildcards)
    both = _with_rules(files, keys)
    many = F.coalesce(F.size("_rules") > RULES_IN_ROW, F.lit(False))
    few = both.filter(~many).withColumn("ignored_by", _first_in_row(F.regexp_replace("rel", r"\\", "/"), F.col("_rules"))).drop("_rules")
    rest = both.filter(many).drop("_rules")
    crowded = keys.join(keys.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RULES_IN_ROW).select("project_id"), "project_id", "left_semi")
    looked = rest.join(_first_by_key(rest.select("project_id", "rel"), crowded, wildcards).withColumnRenamed("rule_path", "ignored_by"), ["project_id", "rel"], "left")
    return few.unionByName(looked)


def apply_ignores(files: DataFrame, rules: DataFrame) -> DataFrame:
    return mark_ignores(files, rules).filter("ignored_by is null").drop("ignored_by")


def ignore_share(marked: DataFrame) -> DataFrame:
    """Rules that hide more than half of a project's files. marked: of `mark_ignores`. One
    aggregate counts by rule, and its few rows are added up per project."""
    counts = marked.groupBy("project_id", "ignored_by").agg(F.count(F.lit(1)).alias("removed"))
    files = F.sum("removed").over(W.partitionBy("project_id"))
    return counts.withColumn("files", files).filter(F.col("ignored_by").isNotNull() & (F.col("removed") * 2 > F.col("files"))).select(
        "project_id", F.col("ignored_by").alias("rule_path"), "removed", "files", F.floor(F.col("removed") * 100 / F.col("files")).alias("percent"))


def ignore_warnings(marked: DataFrame) -> DataFrame:
    return ignore_share(marked).select("project_id", F.lit("E-SCAN-020").alias("code"), F.col("rule_path").alias("path"))


# ---- units -------------------------------------------------------------------

NAME_SCHEMA = "base string, ecosystem string, role string, name_rank int"


def discover_units(files: DataFrame) -> DataFrame:
    """Directories with a manifest or lockfile: (project, dir, ecosystem) with the
    best-ranked file of each role. Manifests inside dependency trees do not count."""
    names = local_frame(files.sparkSession, fixed.MANIFEST_NAMES, NAME_SCHEMA)
    own = files.filter(~inside_dependency_dir()).select("project_id", "rel", text.base_name("rel").alias("base"), text.dir_name("rel").alias("dir"))
    hit = own.join(small_side(names), "base")
    best = lambda role: F.min_by(F.when(F.col("role") == role, F.col("rel")), F.when(F.col("role") == role, F.struct("name_rank", "rel")))
    return hit.groupBy("project_id", "dir", "ecosystem").agg(
        best("manifest").alias("manifest"), best("lockfile").alias("lockfile"),
        # at most one file per unsupported name in a directory
        F.array_sort(F.collect_set(F.when(F.col("role") == "unsupported", F.col("rel")))).alias("unsupported_lockfiles"))


def unsupported_warnings(units: DataFrame) -> DataFrame:
    return units.select("project_id", F.lit("E-PARSE-001").alias("code"), F.explode("unsupported_lockfiles").alias("path"))


def stale_lockfiles(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units whose manifest is more than a minute newer than their lockfile."""
    t = files.select("project_id", "rel", "modification_time")
    m = t.select("project_id", F.col("rel").alias("manifest"), F.col("modification_time").alias("_m"))
    k = t.select("project_id", F.col("rel").alias("lockfile"), F.col("modification_time").alias("_l"))
    both = units.filter(F.col("manifest").isNotNull() & F.col("lockfile").isNotNull()).join(m, ["project_id", "manifest"]).join(k, ["project_id", "lockfile"])
    newer = F.unix_micros(F.col("_m").cast("timestamp")) - F.unix_micros(F.col("_l").cast("timestamp")) > fixed.LOCKFILE_STALE_SECONDS * 1000000
    return both.filter(newer).select("project_id", "dir", "ecosystem", "manifest", "lockfile", F.lit("E-SCAN-015").alias("code"))
