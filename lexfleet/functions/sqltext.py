"""Small helpers to write one SQL expression instead of hundreds of column calls.

Rule sets and word lists become one parsed expression: the plan is the same, but
building it takes one call instead of one per literal.
"""


def quote(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_list(sql: str, values) -> str:
    return f"{sql} IN ({', '.join(quote(v) for v in values)})"


def contains_all(sql: str, needles) -> str:
    return "(" + " AND ".join(f"contains({sql}, {quote(n)})" for n in needles) + ")"


def contains_any(sql: str, needles) -> str:
    return "(" + " OR ".join(f"contains({sql}, {quote(n)})" for n in needles) + ")"


def case(branches, otherwise="NULL") -> str:
    """Ordered (condition, result) SQL pairs: the first true one wins."""
    branches = list(branches)
    if not branches:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in branches) + f" ELSE {otherwise} END"
