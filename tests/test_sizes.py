"""Plans that must not change with the size of the tables."""

import pytest
from pyspark.sql import functions as F

from lexfleet.operators import ownership as own
from lexfleet.operators.ranking import ordinal_within, running_total
from lexfleet.plans import file_queries as fq, report_queries as rq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_made_from_parts_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for made in (rq._source_files(spark, SF), fq.part_texts(spark, SF, F.lit("x"))):
        assert made.rdd.getNumPartitions() >= cores > 1


@pytest.mark.parametrize("name", ["cargo_lock_blocks", "poetry_locks", "go_mod_blocks"])
def test_lockfiles_are_not_read_before_they_are_dealt_out(spark, name):
    from lexfleet.plans import load_queries

    below = plan(load_queries()[name](spark, SF)).split("Exchange hashpartitioning", 1)[1]
    assert "package" not in below and "require" not in below


def test_no_side_that_explode_makes_is_broadcast(spark):
    files = spark.range(50).select(F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("project_id"), F.concat(F.lit("app/x/f"), F.col("id").cast("string")).alias("rel"))
    units = files.select("project_id", F.explode(F.array(F.lit("app"), F.lit("."))).alias("dir"))
    scoped = own.containing_scope(files, units)
    assert "BroadcastExchange" not in plan(scoped)
    assert scoped.filter("scope = 'app'").count() == 50


def test_small_groups_are_numbered_without_a_checkpoint(spark):
    rows = spark.range(900).select((F.col("id") % 7).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("k"))
    placed = ordinal_within(rows, ["g"], ["k"])
    assert "ExistingRDD" not in plan(placed)


def test_groups_beyond_the_limit_are_cut_and_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v"))
    for f in (lambda **x: ordinal_within(rows, ["g"], ["k"], "p", **x), lambda **x: running_total(rows, ["g"], ["k"], "v", "p", **x)):
        whole, cut = f(), f(limit=100)  # the null group has a thousand rows
        assert "ExistingRDD" in plan(cut)
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_rules_that_share_an_id_stay_apart(spark):
    from lexfleet.operators import predicate_rows

    rules = spark.createDataFrame([("a", "true"), ("a", "{"), ("b", "true"), ("b", "true")], "rule_id string, when_text string")
    got = sorted((r.rule_id, r.error or "", r.sentence or "") for r in predicate_rows.described(rules).collect())
    assert got == [("a", "", "true"), ("a", "the text is no JSON", ""), ("b", "", "true"), ("b", "", "true")]


def test_proofs_of_deep_trees_have_plans_that_grow_by_the_level(spark):
    from lexfleet.operators import digests as dg

    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))
    leaves = dg.leaves(rows, "name", F.col("name"))
    sizes = []
    for depth in (2, 4, 6):
        proofs = dg.proofs(rows.filter("name in ('f7', 'f8')"), leaves, dg.merkle(leaves, depth), depth)
        sizes.append(proofs._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert sizes[2] - sizes[1] <= sizes[1] - sizes[0] <= 6
    assert sorted(r.name for r in proofs.collect()) == ["f7", "f8"] and all(len(r.path) == 6 for r in proofs.collect())


@pytest.mark.parametrize("name,scans", [("report_lines", 3), ("markdown_lines", 3), ("verdict_json", 3), ("clock_free_hash", 6)])
def test_documents_read_the_line_items_once_a_use(spark, name, scans):
    """One pass for the verdicts, one for all items of a document, one for the counts."""
    from lexfleet.plans import load_queries

    text = load_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_partkey" in line for line in text.splitlines()) <= scans


def test_few_rules_are_tried_in_the_row_and_many_by_key(spark):
    """The same first rule both ways, and files that no rule makes into more rows."""
    from lexfleet.sources import files as fs

    paths = [f"{a}/{b}/{c}" for a in "xy" for b in ("n", "m", "n m") for c in ("1.py", "2.js")] + ["1.py", "x/1.py", "y\\n\\q.py"]
    files = spark.createDataFrame([(p, r) for p in ("few", "many", "none") for r in paths], "project_id string, rel string")
    shapes = ["**/1.py", "x/n/**", "y/*/2.js", "x/*", "1.py", "y/n", "**", "y/**"]
    rules = spark.createDataFrame([("few", i, r) for i, r in enumerate(shapes)] + [("many", i, r) for i, r in enumerate(shapes)]
                                  + [("many", 100 + i, f"z/{i}/**") for i in range(fs.RULES_IN_ROW)], "project_id string, ordinal int, path string")
    for wildcards in (False, True):
        marked = fs.mark_ignores(files, rules, wildcards=wildcards)
        got = {}
        for r in marked.collect():
            got.setdefault(r.project_id, []).append((r.rel, r.ignored_by))
        assert sorted(got["few"], key=str) == sorted(got["many"], key=str) and len(got["none"]) == len(paths)
        assert any(by for _, by in got["few"]) and not any(by for _, by in got["none"])
    few = fs._with_rules(files, fs.ignore_keys(rules))
    assert "explode" not in plan(few) and few.count() == files.count()


def test_exceptions_are_joined_once(spark):
    from lexfleet.operators import orgpolicy

    ex = spark.createDataFrame([("a", 3, "d", None, "any"), ("a", 1, "d", "k", "named"), ("a", 5, "d", "l", "late"), ("b", 1, "e", "k", "other")],
                               "org string, ordinal int, dependency string, kind string, owner string").withColumn("expires", F.lit("2027-01-01")).withColumn("reason", F.lit("r"))
    found = spark.createDataFrame([("a", "d", "k"), ("a", "d", "l"), ("a", "d", "m"), ("a", "e", "k"), ("b", "e", "k"), ("b", "e", "l"), ("a", "d", None), (None, "d", "k")],
                                  "org string, dependency_id string, rule_id string")
    matched = orgpolicy.match_exceptions(found, ex)
    assert matched._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    got = {(r.org, r.dependency_id, r.rule_id): r.exception and r.exception.owner for r in matched.collect()}
    assert got == {("a", "d", "k"): "named", ("a", "d", "l"): "any", ("a", "d", "m"): "any", ("a", "e", "k"): None, ("b", "e", "k"): "other",
                   ("b", "e", "l"): None, ("a", "d", None): None, (None, "d", "k"): None}


def test_sarif_rules_evaluate_once(spark):
    from lexfleet.plans import load_queries

    text = load_queries()["sarif_rules"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_partkey" in line for line in text.splitlines()) == 1


def test_payloads_are_written_and_read_once_a_row(spark):
    text = rq.payload_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson(") == 1 and text.count("to_json(") <= 1, text


def test_files_with_an_owner_are_made_once(spark):
    from lexfleet.plans import load_queries

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan, with the shuffles it reuses
    try:
        assert plan(load_queries()["longest_prefix_owner"](spark, SF)).count("FileScan parquet") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.fixture
def whole_plans(spark):
    """Plans with the shuffles they reuse and the stages they compile."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_rules_and_items_are_steps_outside_of_whole_stages(spark, whole_plans):
    from lexfleet.plans import core
    from lexfleet.sinks import reports

    lines = plan(reports.document_items(core.rule_outcomes(spark, SF))).splitlines()
    for made in (" AS _hits", " AS _cells"):
        steps = [line for line in lines if made in line]
        assert steps and not any("*(" in line.split("Project")[0] for line in steps)


@pytest.mark.parametrize("name,most", [("verdict_json", 1), ("clock_free_hash", 1), ("sarif_documents", 1), ("spdx_documents", 1), ("warning_order", 1)])
def test_readers_of_the_same_rows_share_their_shuffles(spark, whole_plans, name, most):
    from lexfleet.plans import load_queries

    text = plan(load_queries()[name](spark, SF))
    assert sum("FileScan parquet" in line and "l_partkey" in line for line in text.splitlines()) <= most


def test_known_sizes_save_the_count_of_a_ranking(spark):
    rows = spark.range(6).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    sizes = spark.createDataFrame([(0, 3), (1, 3)], "g long, _n long")
    broken = rows.withColumn("k", F.when(F.col("k") >= 0, F.raise_error(F.lit("made"))).cast("long"))
    ordinal_within(broken, ["g"], ["k"], sizes=sizes)  # makes no row
    for limit in (2, 9):
        assert sorted(tuple(r) for r in ordinal_within(rows, ["g"], ["k"], limit=limit, sizes=sizes).collect()) == [(0, 0, 1), (0, 2, 2), (0, 4, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3)]
