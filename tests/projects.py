"""Small projects with known outcomes: files, declared use, expected result."""

import struct

MIT_TEXT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this.\nTHE SOFTWARE IS PROVIDED WITHOUT WARRANTY OF ANY KIND\n"
AGPL_TEXT = "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n"


def lock(**packages):
    body = ",".join(f'"node_modules/{n}":{{"version":"{v}","license":"{lic}"}}' if lic else f'"node_modules/{n}":{{"version":"{v}"}}'
                    for n, (v, lic) in packages.items())
    return '{"lockfileVersion":3,"packages":{"":{},' + body + "}}"


def manifest(**deps):
    return '{"name":"m","dependencies":{' + ",".join(f'"{n}":"{v}"' for n, v in deps.items()) + "}}"


def npm(**packages):
    return {"package.json": manifest(**{n: v for n, (v, _) in packages.items()}), "package-lock.json": lock(**packages)}


SAFETENSORS = struct.pack("<Q", 16) + b'{"a":{}}        ' + b"\0" * 32


def gguf(**strings):
    out = b"GGUF" + struct.pack("<IQQ", 3, 0, len(strings) + 1)
    out += struct.pack("<Q", 3) + b"arr" + struct.pack("<IIQ", 9, 4, 3) + b"\0" * 12
    for k, v in strings.items():
        k, v = k.replace("__", ".").encode(), v.encode()
        out += struct.pack("<Q", len(k)) + k + struct.pack("<I", 8) + struct.pack("<Q", len(v)) + v
    return out


SHIPPED = dict(use_commercial=True, use_licence_model="closed-source", use_modified=False, use_network_exposed=False, use_distributed=True, use_saas=False)
INTERNAL = dict(SHIPPED, use_distributed=False)
LODASH = dict(lodash=("4.17.21", "MIT"))
LODASH_FOUND = {("npm:lodash@4.17.21", "mit.attribution", "CONDITION"), ("npm:lodash@4.17.21", "mit.no-patent-grant", "NOTE")}


def apache_found(dep):
    return {(dep, "apache-2.0.licence-inclusion", "CONDITION"), (dep, "apache-2.0.notice-retention", "CONDITION"), (dep, "apache-2.0.patent-grant", "NOTE"),
            (dep, "apache-2.0.trademark-exclusion", "NOTE"), (dep, "trap.patent.retaliation", "NOTE")}


ABSENT = "trap.licence.absent-all-rights-reserved"

# name -> (files, use, verdict, findings, undetermined, warnings, notices)
PROJECTS = {
    "agpl-modified-network": (
        npm(**{"agpl-tool": ("3.0.0", "AGPL-3.0")}),
        dict(INTERNAL, use_commercial=False, use_modified=True, use_network_exposed=True, use_saas=True), "DO_NOT_SHIP",
        {("npm:agpl-tool@3.0.0", "agpl-3.0.network-disclosure", "BLOCK"), ("npm:agpl-tool@3.0.0", "trap.agpl.modified-network-service", "BLOCK")}, set(), [], []),
    "agpl-unmodified-network": (
        npm(**{"agpl-tool": ("3.0.0", "AGPL-3.0")}), dict(INTERNAL, use_network_exposed=True), "SHIP_CONDITIONAL",
        {("npm:agpl-tool@3.0.0", "agpl-3.0.network-unmodified", "CONDITION")}, set(), [], []),
    "agpl-unmodified-internal": (npm(**{"agpl-tool": ("3.0.0", "AGPL-3.0")}), INTERNAL, "SHIP", set(), set(), [], []),
    "mixed": (
        npm(lodash=("4.17.21", "MIT"), leftpad=("1.0.0", "WTFPL")), SHIPPED, "UNDETERMINED", LODASH_FOUND, {("npm:leftpad@1.0.0", "no_corpus_entry")}, [], ["E-POLICY-001"]),
    "no-licence-at-all": (
        npm(**{"mystery-package": ("0.1.0", "")}), SHIPPED, "UNDETERMINED", {("npm:mystery-package@0.1.0", ABSENT, "CONDITION")},
        {("npm:mystery-package@0.1.0", "licence_unresolved")}, [], []),
    "dual-mit-or-apache": (
        npm(**{"dual-tool": ("1.0.0", "MIT OR Apache-2.0")}), SHIPPED, "UNDETERMINED", set(), {("npm:dual-tool@1.0.0", "no_corpus_entry")}, [], ["E-POLICY-001"]),
    "code-weights-divergence": (
        {**npm(**LODASH), "models/config.json": '{"license": "cc-by-nc-4.0"}', "models/model.safetensors": SAFETENSORS}, SHIPPED, "DO_NOT_SHIP",
        LODASH_FOUND | {("weights:models/model.safetensors", k, s) for k, s in (
            ("cc-by-nc-4.0.attribution", "CONDITION"), ("cc-by-nc-4.0.non-commercial", "BLOCK"), ("trap.code-weights-divergence", "BLOCK"),
            ("trap.weights.cc-by-nc-commercial", "BLOCK"))}, set(), [], []),
    "declared-vs-actual-conflict": (
        {**npm(**LODASH), "node_modules/lodash/LICENSE": AGPL_TEXT}, INTERNAL, "SHIP_CONDITIONAL",
        {("vendored:node_modules/lodash/LICENSE", "trap.declared-vs-actual-conflict", "CONDITION")}, set(), [], []),
    "cargo-vendored-licence": (
        {"Cargo.toml": '[package]\nname = "m"\n[dependencies]\nserde = "1.0.210"\n', "vendor/serde/LICENSE": MIT_TEXT}, SHIPPED, "SHIP_CONDITIONAL",
        {("cargo:serde@1.0.210", "mit.attribution", "CONDITION"), ("cargo:serde@1.0.210", "mit.no-patent-grant", "NOTE")}, set(), [], []),
    "weights-gguf-metadata": (
        {**npm(**LODASH), "models/model.gguf": gguf(general__name="x", general__license="apache-2.0")}, SHIPPED, "SHIP_CONDITIONAL",
        LODASH_FOUND | apache_found("weights:models/model.gguf"), set(), [], []),
    "weights-frontmatter": (
        {**npm(**LODASH), "models/model.safetensors": SAFETENSORS, "models/README.md": "---\nlicense: apache-2.0\n---\n# x\n"}, SHIPPED, "SHIP_CONDITIONAL",
        LODASH_FOUND | apache_found("weights:models/model.safetensors"), set(), [], []),
    "weights-prose-sibling": (
        {**npm(**LODASH), "models/model.safetensors": SAFETENSORS, "models/MODEL_NOTES.md": "Licensed under the Apache License, Version 2.0.\n"}, SHIPPED, "SHIP_CONDITIONAL",
        LODASH_FOUND | apache_found("weights:models/model.safetensors"), set(), [], []),
    "weights-no-licence": (
        {**npm(**LODASH), "models/model.safetensors": SAFETENSORS}, SHIPPED, "UNDETERMINED", LODASH_FOUND | {("weights:models/model.safetensors", ABSENT, "CONDITION")},
        {("weights:models/model.safetensors", "licence_not_found"), ("weights:models/model.safetensors", "licence_unresolved")}, [], []),
    "upstream-unknown-platform": (
        {"go.mod": "module m\n", "internal/media/fetch.go": 'package m\nfunc f() { exec.Command("yt-thing", "-x") }\n'}, INTERNAL, "SHIP", set(), set(), [], ["E-CORPUS-004"]),
    "upstream-sdk-import": (
        npm(openai=("4.0.0", "Apache-2.0")), INTERNAL, "SHIP_CONDITIONAL",
        {("npm:openai@4.0.0", "apache-2.0.patent-grant", "NOTE"), ("npm:openai@4.0.0", "openai.tos.usage-policies", "CONDITION"),
         ("npm:openai@4.0.0", "openai.tos.competing-models", "CONDITION")}, set(), [], []),
    "excluded-brand-assets": (
        {"go.mod": "module m\n", "vendor/acme-forked-tool/TRADEMARKS.md": "The Acme trademark is not licensed.\n"}, SHIPPED, "SHIP_CONDITIONAL",
        {("asset:vendor/acme-forked-tool", "trap.assets.brand-reserved", "CONDITION")}, set(), [], []),
    "brand-assets-internal": ({"go.mod": "module m\n", "vendor/acme-forked-tool/TRADEMARKS.md": "The Acme trademark is not licensed.\n"}, INTERNAL, "SHIP", set(), set(), [], []),
    "npm-lockfile-resolves-range": (
        {"package.json": manifest(lodash="^4.17.0"), "package-lock.json": lock(**LODASH)}, SHIPPED, "SHIP_CONDITIONAL", LODASH_FOUND, set(), [], []),
    "malformed-lockfile": (
        {"package.json": manifest(lodash="4.17.21"), "package-lock.json": '{"packages": {'}, SHIPPED, "UNDETERMINED", {("npm:lodash@4.17.21", ABSENT, "CONDITION")},
        {("npm:lodash@4.17.21", "licence_unresolved")}, ["E-PARSE-001", "E-PARSE-001"], []),
    "go-replace-directive": (
        {"go.mod": "module m\nrequire github.com/old/thing v1.0.0\nreplace github.com/old/thing => github.com/new/thing v2.0.0\n"}, INTERNAL, "UNDETERMINED",
        {("go:github.com/new/thing@v2.0.0", ABSENT, "CONDITION")}, {("go:github.com/new/thing@v2.0.0", "licence_unresolved")}, [], []),
    "opaque-launch": (
        {"go.mod": "module m\n", "m.go": "package m\nfunc f(c string) { exec.Command(c) }\n"}, INTERNAL, "SHIP", set(), set(), ["E-SCAN-021"], []),
    "empty": ({"README.txt": "nothing"}, SHIPPED, "SHIP", set(), set(), [], []),
}


def write(root):
    for project, (files, *_rest) in PROJECTS.items():
        for rel, body in files.items():
            path = root / project / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body if isinstance(body, bytes) else body.encode())
