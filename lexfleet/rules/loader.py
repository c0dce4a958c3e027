"""The rule corpus: read at plan time (it is bounded), exposed as dimension tables.

A corpus is four JSON documents. It is data, capped at 64 MiB, so the driver may
hold it: predicates have to be compiled into the plan before a job can start.
"""

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import SparkSession

from lexfleet.functions import fixed
from lexfleet.operators import predicates
from lexfleet.session import local_frame

MAX_CORPUS_BYTES = 64 << 20
DOCUMENTS = ("licences", "traps", "platforms", "territories")

CITATION = "citation_url string, citation_section string, citation_retrieved_at string, citation_excerpt string, citation_excerpt_kind string"
FIX = "fix_action string, fix_suggestion string, fix_alternative string, fix_confidence string"
LICENCE_SCHEMA = (
    "licence_id string, spdx_id string, spdx_key string, family string, osi_approved boolean, fsf_libre boolean, "
    "permissiveness int, entry_confidence string, last_verified string, "
    "correction_reason string, correction_evidence string, correction_from string, correction_to string, "
    "corrected_at string, corrected_by string, " + CITATION
)
RULE_SCHEMA = (
    "rule_id string, source string, spdx_key string, ordinal int, obligation_kind string, scope string, severity string, "
    "confidence string, title string, message string, when_json string, when_text string, fields array<string>, "
    + CITATION + ", " + FIX
)
PLATFORM_SCHEMA = "platform string, display_name string, platform_kind string, last_verified string, staleness_days int"
TOKEN_SCHEMA = "platform string, signal string, token string"
CLAUSE_SCHEMA = (
    "platform string, clause_id string, ordinal int, severity string, confidence string, text_summary string, "
    "when_json string, " + CITATION
)
GATE_SCHEMA = "territory string, gate_id string, severity string, confidence string, summary string, " + CITATION
CITATION_SCHEMA = "load_order int, owner string, url string, section string, excerpt string, excerpt_kind string"

_SIGNAL_KEYS = {"bins": "bin", "runners": "runner", "hosts": "host", "env": "env", "imports": "import", "images": "image"}


class CorpusError(ValueError):
    pass


def _citation(c):
    c = c or {}
    return (c.get("url"), c.get("section"), c.get("retrieved_at"), c.get("excerpt"), c.get("excerpt_kind"))


def _fix(f):
    f = f or {}
    return (f.get("action"), f.get("suggestion"), f.get("alternative"), f.get("confidence"))


@dataclass
class Corpus:
    documents: dict
    digest: str = ""
    version: str = "2026.09"

    @property
    def licences(self):
        return self.documents["licences"]

    @property
    def traps(self):
        return self.documents["traps"]

    @property
    def platforms(self):
        return self.documents["platforms"]

    @property
    def territories(self):
        return self.documents["territories"]

    def dependency_traps(self):
        """Catalogue traps decided by their own predicate alone."""
        return [t for t in self.traps if t.get("scope", "dependency") != "graph"]

    def trap(self, trap_id):
        return next((t for t in self.traps if t["id"] == trap_id), None)

    @cached_property
    def licence_rows(self):
        rows = []
        for e in self.licences:
            k = e.get("correction") or {}
            rows.append((
                e["id"], e["spdx_id"], e["spdx_id"].upper(), e["family"], e.get("osi_approved"), e.get("fsf_libre"),
                e["permissiveness"], e["confidence"], e.get("last_verified"),
                k.get("reason"), k.get("evidence"), k.get("from"), k.get("to"), k.get("corrected_at"), k.get("corrected_by"),
                *_citation(e.get("citation")),
            ))
        return rows

    def _rule(self, r, source, key, i):
        when = r.get("when", True)
        obligation = source == "obligation"
        return (
            r["id"], source, key, i, r.get("kind"), r.get("scope"), r["severity"], r["confidence"],
            (r.get("kind", "") + " obligation") if obligation else r.get("title"),
            r.get("message") if obligation else r.get("summary"),
            json.dumps(when), predicates.sentence(when), predicates.fields_of(when),
            *_citation(r.get("citation")), *_fix(r.get("fix")),
        )

    @cached_property
    def rule_rows(self):
        rows = []
        for e in self.licences:
            key = e["spdx_id"].upper()
            rows += [self._rule(o, "obligation", key, i) for i, o in enumerate(e.get("obligations", []))]
            rows += [self._rule(t, "own_trap", key, i) for i, t in enumerate(e.get("traps", []))]
        rows += [self._rule(t, "trap", None, i) for i, t in enumerate(self.traps)]
        return rows

    @cached_property
    def citation_rows(self):
        """Every citation in load order, with the entry that carries it."""
        out = []

        def add(owner, c):
            if c and c.get("url") and c.get("section"):
                out.append((len(out), owner, c["url"], c["section"], c.get("excerpt"), c.get("excerpt_kind")))

        for e in self.licences:
            add(e["id"], e.get("citation"))
            for r in e.get("obligations", []) + e.get("traps", []):
                add(r["id"], r.get("citation"))
        for t in self.traps:
            add(t["id"], t.get("citation"))
        for p in self.platforms:
            for c in p.get("clauses", []):
                add(c["id"], c.get("citation"))
        for t in self.territories:
            for g in t.get("gates", []):
                add(g["id"], g.get("citation"))
        return out

    def frame(self, spark: SparkSession, name: str):
        """One dimension table: licences, rules, platforms, platform_tokens,
        platform_clauses, territory_gates, citations."""
        if name == "licences":
            return local_frame(spark, self.licence_rows, LICENCE_SCHEMA)
        if name == "rules":
            return local_frame(spark, self.rule_rows, RULE_SCHEMA)
        if name == "platforms":
            return local_frame(
                spark, [(p["platform"], p["display_name"], p["kind"], p["last_verified"], p["staleness_days"]) for p in self.platforms],
                PLATFORM_SCHEMA)
        if name == "platform_tokens":
            rows = [(p["platform"], _SIGNAL_KEYS[k], t) for p in self.platforms
                    for k, tokens in p.get("detect", {}).items() for t in tokens]
            return local_frame(spark, rows, TOKEN_SCHEMA)
        if name == "platform_clauses":
            rows = [(p["platform"], c["id"], i, c["severity"], c["confidence"], c["text_summary"],
                     json.dumps(c.get("when", True)), *_citation(c.get("citation")))
                    for p in self.platforms for i, c in enumerate(p.get("clauses", []))]
            return local_frame(spark, rows, CLAUSE_SCHEMA)
        if name == "territory_gates":
            rows = [(t["code"], g["id"], g["severity"], g["confidence"], g["summary"], *_citation(g.get("citation")))
                    for t in self.territories for g in t.get("gates", [])]
            return local_frame(spark, rows, GATE_SCHEMA)
        if name == "citations":
            return local_frame(spark, self.citation_rows, CITATION_SCHEMA)
        raise KeyError(name)


def _refuse_duplicates(label, keys):
    seen = set()
    for k in keys:
        if k in seen:
            raise CorpusError(f"duplicate {label}: {k}")
        seen.add(k)


def build(documents: dict, digest="") -> Corpus:
    """Check a corpus and index it. Duplicate keys and bad predicates are refused."""
    c = Corpus({k: documents.get(k, []) for k in DOCUMENTS}, digest)
    _refuse_duplicates("licence", [e["spdx_id"].upper() for e in c.licences])
    _refuse_duplicates("trap", [t["id"] for t in c.traps])
    _refuse_duplicates("platform", [p["platform"].lower() for p in c.platforms])
    _refuse_duplicates("territory", [t["code"].upper() for t in c.territories])
    for rules in [e.get("obligations", []) + e.get("traps", []) for e in c.licences] + [c.traps] + [p.get("clauses", []) for p in c.platforms]:
        for r in rules:
            try:
                predicates.check(r.get("when", True))
            except predicates.PredicateError as err:
                raise CorpusError(f"{r['id']}: {err}") from err
            if r["severity"] not in fixed.SEVERITY_WEIGHT or r["confidence"] not in fixed.CONFIDENCE_WEIGHT:
                raise CorpusError(f"{r['id']}: bad severity or confidence")
    return c


def load(directory=None) -> Corpus:
    """Read a corpus directory; with a manifest.json, sizes and digests must match."""
    root = Path(directory) if directory else Path(__file__).parent
    blobs = {name: (root / f"{name}.json").read_bytes() for name in DOCUMENTS}
    if sum(len(b) for b in blobs.values()) > MAX_CORPUS_BYTES:
        raise CorpusError("corpus is larger than 64 MiB")
    manifest = root / "manifest.json"
    if manifest.exists():
        want = json.loads(manifest.read_text())
        for name, blob in blobs.items():
            if want["files"].get(f"{name}.json") != hashlib.sha256(blob).hexdigest():
                raise CorpusError(f"{name}.json does not match its manifest digest")
    digest = hashlib.sha256(b"".join(blobs[n] for n in DOCUMENTS)).hexdigest()
    return build({n: json.loads(b) for n, b in blobs.items()}, digest)
