"""Compiled predicates against a plain statement of three-valued logic."""

import itertools
import json
import random

import pytest

from lexfleet.operators import predicates as p

BOOLS = [("a", "use.commercial"), ("b", "use.saas")]


def leaf(field, value=1, op=">"):
    return {"op": op, "field": field, "value": value}


def plain(tree, row):
    """(truth, field) by the book: left first, FALSE beats UNKNOWN in and, TRUE in or."""
    if tree is None or isinstance(tree, bool):
        return tree is not False, None
    if tree["op"] in ("and", "or"):
        (a, fa), (b, fb) = plain(tree["l"], row), plain(tree["r"], row)
        strong = tree["op"] == "or"
        if a is strong or b is strong:
            return strong, None
        if a is (not strong) and b is (not strong):
            return not strong, None
        return None, fa or fb
    if tree["op"] == "not":
        a, f = plain(tree["x"], row)
        return (None, f) if a is None else (not a, None)
    v = row[tree["field"]]
    if v is None:
        return None, tree["field"]
    return v > tree["value"], None


def test_and_or_not_truth_tables(spark):
    fields = ["scale.mau", "scale.employees", "scale.revenue_eur"]
    x, y, z = (leaf(f) for f in fields)
    trees = [{"op": o1, "l": a, "r": {"op": o2, "l": b, "r": {"op": "not", "x": c}}}
             for o1, o2 in itertools.product(["and", "or"], repeat=2) for a, b, c in itertools.permutations([x, y, z])]
    trees += [{"op": "not", "x": t} for t in trees] + [True, False, None]
    values = list(itertools.product([0, 2, None], repeat=3))
    df = spark.createDataFrame(values, "scale_mau long, scale_employees long, scale_revenue_eur long")
    compiled = [p.compile_predicate(t) for t in trees]
    rows = df.select("*", *[c.truth.alias(f"t{i}") for i, c in enumerate(compiled)], *[c.field.alias(f"f{i}") for i, c in enumerate(compiled)]).collect()
    for r in rows:
        row = {"scale.mau": r.scale_mau, "scale.employees": r.scale_employees, "scale.revenue_eur": r.scale_revenue_eur}
        for i, t in enumerate(trees):
            assert (r[f"t{i}"], r[f"f{i}"]) == plain(t, row), (t, row)


def territories(op, value, lists):
    """By the book: folded case, an empty list is unknown, global is special."""
    out = []
    for t in lists:
        if not t:
            out.append(None)
            continue
        up = [x.upper() for x in t]
        if op == "contains":
            out.append("GLOBAL" in up or value.upper() in up)
        elif op == "in":
            out.append("GLOBAL" not in up and all(x in {v.upper() for v in value} for x in up))
        else:
            out.append((len(t) == 1 and up[0] == value.upper()) == (op == "=="))
    return out


def test_territory_lists(spark):
    lists = [[], ["US"], ["us"], ["EU", "GB"], ["Global"], ["EU", "global"], ["CN"], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, territories array<string>")
    for op, value in [("contains", "eu"), ("contains", "US"), ("in", ["us", "EU", "GB"]), ("in", ["GLOBAL", "CN"]), ("==", "us"), ("!=", "us")]:
        c = p.compile_predicate({"op": op, "field": "territories", "value": value})
        got = [(r.t, r.f) for r in df.select("i", c.truth.alias("t"), c.field.alias("f")).orderBy("i").collect()]
        want = territories(op, value, lists)
        assert got == [(w, "territories" if w is None else None) for w in want], (op, value)


@pytest.mark.parametrize("tree", [
    {"op": ">", "field": "use.saas", "value": 1}, {"op": "==", "field": "no.such", "value": 1}, {"op": "in", "field": "use.licence_model", "value": "dual"},
    {"op": "==", "field": "dep.kind", "value": "thing"}, {"op": "contains", "field": "scale.mau", "value": "1"}, {"op": "==", "field": "scale.mau", "value": 1.5},
    {"op": "==", "field": "use.saas", "value": "true"}, {"op": "and", "l": True}, {"op": "xor", "l": True, "r": True}, "use.saas", {"op": "in", "field": "territories", "value": []}])
def test_bad_predicates_are_refused(tree):
    with pytest.raises(p.PredicateError):
        p.compile_predicate(tree)


def test_depth_limit():
    tree = True
    for _ in range(10):
        tree = {"op": "not", "x": tree}
    tree = {"op": "and", "l": tree, "r": leaf("scale.mau")}
    with pytest.raises(p.PredicateError):
        p.check({"op": "not", "x": {"op": "not", "x": _deep(9)}})


def _deep(n):
    return leaf("scale.mau") if n == 0 else {"op": "not", "x": _deep(n - 1)}


def test_sentence_and_fields():
    t = {"op": "or", "l": {"op": "not", "x": leaf("scale.mau", 5, ">=")}, "r": {"op": "in", "field": "dep.kind", "value": ["asset", "weights"]}}
    assert p.sentence(t) == "(not scale.mau >= 5 or dep.kind in [asset, weights])"
    assert p.fields_of(t) == ["dep.kind", "scale.mau"]


def test_quotes_in_values(spark):
    df = spark.createDataFrame([("it's \\ odd",), ("plain",)], "dep_name string")
    c = p.compile_predicate({"op": "==", "field": "dep.name", "value": "it's \\ odd"})
    assert [r.t for r in df.select(c.truth.alias("t")).collect()] == [True, False]


def _random_tree(rng, depth=0):
    kind = rng.random()
    if kind < 0.45 and depth < 11:
        return {"op": rng.choice(["and", "or"]), "l": _random_tree(rng, depth + 1), "r": _random_tree(rng, depth + 1)}
    if kind < 0.55 and depth < 11:
        return {"op": "not", "x": _random_tree(rng, depth + 1)}
    if kind < 0.6:
        return rng.choice([True, False, None])
    if kind < 0.63:
        return rng.choice([7, "text", [], {}, {"op": "and", "l": True}, {"op": "==", "field": "use.saas"}, {"op": "not", "x": True, "y": 1}, {"field": "use.saas", "value": True}])
    field = rng.choice([*p.FIELDS, *p.FIELDS, "no.such"])
    op = rng.choice(["==", "!=", "in", "contains", ">=", "<", "like"]) if rng.random() < 0.1 else rng.choice(sorted(p.OPS_BY_TYPE.get(p.FIELDS.get(field), {"=="})))
    names = ["MIT", "package", "permissive", "open-source", "EU"]
    good = {p.BOOL: rng.choice([True, False]), p.INT: rng.choice([0, -3, 10**12, 4.0]), p.ENUM: rng.choice(sorted(p.ENUMS.get(field, ["x"]))), p.STRING: rng.choice(names), p.LIST: rng.choice(names)}
    value = good.get(p.FIELDS.get(field), 1)
    if op == "in":
        value = [value, rng.choice(sorted(p.ENUMS.get(field, names)))]
    if rng.random() < 0.06:
        value = rng.choice([None, 1.5, True, 3, "x", [], [1], ["x"], {}])
    return {"op": op, "field": field, "value": value}


def test_trees_as_rows(spark):
    """The recursive walk against the check of one tree at a time."""
    from lexfleet.operators import predicate_rows as pr

    rng = random.Random(5)
    trees = [_random_tree(rng) for _ in range(400)]
    rows = [(str(i), json.dumps(t)) for i, t in enumerate(trees)] + [("none", None), ("null", "null"), ("broken", "{"), ("empty", "")]
    got = {r.rule_id: r for r in pr.described(spark.createDataFrame(rows, "rule_id string, when_text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    assert (got["none"].sentence, got["null"].sentence, got["broken"].error, got["empty"].error) == ("true", "true", "the text is no JSON", "the text is no JSON")
    fine = 0
    for i, t in enumerate(trees):
        r = got[str(i)]
        try:
            p.check(t)
        except p.PredicateError as e:
            assert r.error and r.sentence is None, (t, str(e))
            continue
        fine += 1
        assert (r.error, r.fields) == (None, p.fields_of(t)), (t, r)
        if "4.0" not in str(t):  # a whole number is written as one
            assert r.sentence == p.sentence(t)
    assert 40 < fine < 390
    assert pr.described(spark.createDataFrame([], "rule_id string, when_text string")).count() == 0
