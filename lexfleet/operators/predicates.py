"""Rule predicates: a finite boolean tree compiled to nullable Catalyst columns.

TRUE / FALSE / UNKNOWN are true / false / NULL, so AND, OR and NOT are SQL's own
and need no UDF. A second column names the first undeclared field behind an
UNKNOWN. Trees are checked when the plan is built, before any job starts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from lexfleet.functions import fixed, sqltext as q

BOOL, INT, STRING, ENUM, LIST = "bool", "int", "string", "enum", "list"

# The predicate fields, their types and the enum members.
FIELDS = {
    "use.commercial": BOOL,
    "use.licence_model": ENUM,
    "use.modified": BOOL,
    "use.network_exposed": BOOL,
    "use.distributed": BOOL,
    "use.saas": BOOL,
    "scale.mau": INT,
    "scale.employees": INT,
    "scale.revenue_eur": INT,
    "territories": LIST,
    "project.name": STRING,
    "dep.kind": ENUM,
    "dep.ecosystem": STRING,
    "dep.licence.family": ENUM,
    "dep.licence.permissiveness": INT,
    "dep.licence.spdx": STRING,
    "dep.licence.resolved": BOOL,
    "dep.name": STRING,
    "dep.version": STRING,
}
ENUMS = {
    "use.licence_model": fixed.LICENCE_MODELS,
    "dep.kind": fixed.KINDS,
    "dep.licence.family": fixed.FAMILIES,
}
OPS_BY_TYPE = {
    BOOL: {"==", "!="},
    INT: {"==", "!=", ">", ">=", "<", "<="},
    STRING: {"==", "!=", "in", "contains"},
    ENUM: {"==", "!=", "in"},
    LIST: {"==", "!=", "in", "contains"},
}


class PredicateError(ValueError):
    pass


def column_name(field: str) -> str:
    return field.replace(".", "_")


def check(tree, depth=0):
    """Raise PredicateError unless the tree is well formed and well typed."""
    if tree is None or isinstance(tree, bool):
        return
    if depth > fixed.PREDICATE_MAX_DEPTH:
        raise PredicateError("predicate is nested too deeply")
    if not isinstance(tree, dict) or "op" not in tree:
        raise PredicateError(f"not a predicate: {tree!r}")
    op = tree["op"]
    if op in ("and", "or"):
        if set(tree) != {"op", "l", "r"}:
            raise PredicateError(f"{op} needs l and r")
        check(tree["l"], depth + 1)
        check(tree["r"], depth + 1)
        return
    if op == "not":
        if set(tree) != {"op", "x"}:
            raise PredicateError("not needs x")
        check(tree["x"], depth + 1)
        return
    if set(tree) != {"op", "field", "value"}:
        raise PredicateError(f"comparison needs field and value: {tree!r}")
    field, value = tree["field"], tree["value"]
    kind = FIELDS.get(field)
    if kind is None:
        raise PredicateError(f"unknown field {field!r}")
    if op not in OPS_BY_TYPE[kind]:
        raise PredicateError(f"operator {op!r} does not apply to {field} ({kind})")
    _check_value(field, kind, op, value)


def _check_value(field, kind, op, value):
    if op == "in":
        if not isinstance(value, list) or not value or not all(isinstance(v, str) for v in value):
            raise PredicateError(f"{field} in needs a non-empty list of strings")
        members = value
    elif kind == BOOL:
        if not isinstance(value, bool):
            raise PredicateError(f"{field} needs a boolean")
        return
    elif kind == INT:
        if isinstance(value, bool) or not (isinstance(value, int) or (isinstance(value, float) and value.is_integer())):
            raise PredicateError(f"{field} needs an integer")
        return
    else:
        if not isinstance(value, str):
            raise PredicateError(f"{field} needs a string")
        members = [value]
    allowed = ENUMS.get(field)
    if allowed:
        for m in members:
            if m not in allowed:
                raise PredicateError(f"{m!r} is not a value of {field}")


def fields_of(tree) -> list:
    """Distinct fields a predicate reads, sorted."""
    if not isinstance(tree, dict):
        return []
    found = {tree["field"]} if "field" in tree else set()
    for k in ("l", "r", "x"):
        found.update(fields_of(tree.get(k)))
    return sorted(found)


def sentence(tree) -> str:
    """Readable form of a predicate."""
    if tree is None or tree is True:
        return "true"
    if tree is False:
        return "false"
    op = tree["op"]
    if op in ("and", "or"):
        return f"({sentence(tree['l'])} {op} {sentence(tree['r'])})"
    if op == "not":
        return f"not {sentence(tree['x'])}"
    value = tree["value"]
    if isinstance(value, bool):
        shown = "true" if value else "false"
    elif isinstance(value, list):
        shown = "[" + ", ".join(value) + "]"
    else:
        shown = str(value)
    return f"{tree['field']} {op} {shown}"


@dataclass(frozen=True)
class Compiled:
    """SQL text of a predicate: nullable truth, and the first undeclared field
    when truth is NULL."""

    truth_sql: str
    field_sql: str

    @property
    def truth(self) -> Column:
        return F.expr(self.truth_sql)

    @property
    def field(self) -> Column:
        return F.expr(self.field_sql)


def compile_predicate(tree, column_sql=None) -> Compiled:
    """Compile a checked tree. `column_sql(path)` is the SQL of a field's column."""
    check(tree)
    return _compile(tree, column_sql or (lambda path: q.ident(column_name(path))))


NO_FIELD = "CAST(NULL AS STRING)"


def _compile(tree, column) -> Compiled:
    if tree is None or isinstance(tree, bool):
        return Compiled(q.quote(tree is not False), NO_FIELD)
    op = tree["op"]
    if op in ("and", "or"):
        left, right = _compile(tree["l"], column), _compile(tree["r"], column)
        truth = f"({left.truth_sql} {op.upper()} {right.truth_sql})"
        return Compiled(truth, f"IF({truth} IS NULL, coalesce({left.field_sql}, {right.field_sql}), NULL)")
    if op == "not":
        inner = _compile(tree["x"], column)
        return Compiled(f"(NOT {inner.truth_sql})", inner.field_sql)

    path, value = tree["field"], tree["value"]
    c = column(path)
    if FIELDS[path] == LIST:
        truth = _list_comparison(op, c, value)
    elif op == "in":
        truth = f"({q.in_list(c, value)})"
    elif op == "contains":
        truth = f"contains({c}, {q.quote(value)})"
    else:
        literal = q.quote(int(value) if isinstance(value, float) else value)
        truth = f"({c} {'<>' if op == '!=' else '=' if op == '==' else op} {literal})"
    return Compiled(truth, f"IF({truth} IS NULL, {q.quote(path)}, NULL)")


def _list_comparison(op, c, value) -> str:
    """Territory lists: folded case, empty or NULL list is UNKNOWN, `global` is special."""
    if op in ("==", "!="):
        same = f"(size({c}) = 1 AND upper(try_element_at({c}, 1)) = {q.quote(value.upper())})"
        body = same if op == "==" else f"(NOT {same})"
    elif op == "contains":
        body = f"exists({c}, x -> upper(x) IN ('GLOBAL', {q.quote(value.upper())}))"
    else:
        allowed = sorted({v.upper() for v in value} - {"GLOBAL"})
        body = f"forall({c}, x -> {q.in_list('upper(x)', allowed) if allowed else 'false'})"
    return f"IF(size({c}) > 0, {body}, CAST(NULL AS BOOLEAN))"
