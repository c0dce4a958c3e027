"""Oracle SQL: one file per query, shared CTEs pulled in by a `-- uses:` line."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[2] / "oracles"


def _uses(text):
    line = text.lstrip().splitlines()[0]
    return [n.strip() for n in line[len("-- uses:"):].split(",")] if line.startswith("-- uses:") else []


def _collect(names, done):
    """`name=other` builds the CTE `name` from the file of `other`."""
    for n in names:
        n, _, source = n.partition("=")
        if n in done:
            continue
        body = (ROOT / "common" / f"{source or n}.sql").read_text()
        _collect(_uses(body), done)
        done[n] = body
    return done


def render(name: str) -> str:
    body = (ROOT / f"{name}.sql").read_text()
    ctes = _collect(_uses(body), {})
    if not ctes:
        return body
    return "with " + ",\n".join(f"{n} as (\n{sql}\n)" for n, sql in ctes.items()) + "\n" + body


def all_sql() -> dict:
    return {p.stem: render(p.stem) for p in sorted(ROOT.glob("*.sql"))}
