"""Plain versions of the operators, for comparison."""

import hashlib
import math
import re


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def pii_row(text):
    spans = pii_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*(sum(k == kind for k, _, _ in spans) for kind in PII), hashlib.sha256(joined.encode()).hexdigest())


def windows_removed(texts, window=200):
    """(bytes, removed, spans, sha256 of the rest) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for b in raw:
        mask, end, spans = bytearray(len(b)), -1, 0
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                spans += i > end
                mask[i : i + window] = b"\1" * window
                end = i + window
        rest = bytes(x for x, m in zip(b, mask) if not m)
        out.append((len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def classes(ids, linked):
    """Smallest id reachable, for pairs `linked`."""
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def shingle_set(text, n=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_classes(rows):
    """id -> (set size, component) for (id, text) rows."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders, linked = {}, []
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        linked += [(i, j) for j, n in shared.items() if 100 * n >= 75 * len(s | sets[j])]
    least = classes(sets, linked)
    return {i: (len(s), least[i]) for i, s in sets.items()}


def sellers(pattern, text):
    """Least edit distance of `pattern` to any part of `text`."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != t)))
        before = now
    return min(before)


def runs(words):
    """(start, length, period) of the maximal stretches with a smallest period q and at
    least max(6, 4q) words, tried period by period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((start, end - start, q) for (start, end), q in found.items())


def without_repeats(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def hard_negatives(rows, anchor, positives=5, negatives=3, least=50, most=95):
    """rows: (id, label, whole numbers). All pairs of anchors and rows."""
    out = set()
    for a, label, v in rows:
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in rows if i != a and len(w) == len(v)]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((s, j) for s, j, k in scored if k != label and least * -p <= 100 * -s <= most * -p)
            out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fit[:negatives], 1)}
    return out


def gram_buckets(text, factors, bits):
    """Bucket numbers of the n-grams of one text, one at a time."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text or ''} ")
    x, out = [ord(c) for c in re.sub(" +", " ", letters)], []
    for i in range(len(x)):
        mixed = 0
        for n, factor in enumerate(factors):
            if i + n >= len(x):
                break
            mixed = (mixed ^ (x[i + n] + n + 1)) * factor % 2**32
            mixed ^= mixed >> 15
            if n or x[i] != 32:
                out.append(mixed * factors[0] % 2**32 >> 32 - bits)
    return out


def naive_bayes(texts, langs, train, factors, bits, smoothing):
    """(language, probability) of every text, from dictionaries of counts."""
    names = sorted({k for k, t in zip(langs, train) if t and k is not None})
    counts, n = {k: {} for k in names}, dict.fromkeys(names, 0)
    for text, k, t in zip(texts, langs, train):
        if t and k is not None:
            n[k] += 1
            for g in gram_buckets(text, factors, bits):
                counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(counts[k].values()) + smoothing * 2**bits for k in names}
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        grams = gram_buckets(text, factors, bits)
        score = {k: math.log(n[k] / sum(n.values())) + sum(math.log((counts[k].get(g, 0) + smoothing) / total[k]) for g in grams) for k in names}
        best = max(names, key=lambda k: score[k])
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())))
    return out


def context_spans(texts, rounds, threshold, support, least):
    """(start, end) of the tokens that a bootstrap over contexts adds to each text. A token of
    these texts holds at most one base span."""
    items = []  # text, start, end, value, patterns, seed
    for i, text in enumerate(texts):
        spans, words = [(a, b) for _, a, b in pii_spans(text)], [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
        tokens = [(a, b) for a, b in words if re.search("[0-9]", text[a:b]) and b - a >= least and not any(c < b and d > a for c, d in spans)]
        for a, b in spans + tokens:
            own = max(s for s, _ in words if s <= a)
            before = [text[s:e].lower() for s, e in words if s < own][-2:]
            lead = text[own:a].lower() if (a, b) in spans else text[a:b].lower()
            key = re.match(r"[^\s0-9=:]+[=:]" + ("$" if (a, b) in spans else ""), lead)
            patterns = {"1 " + before[-1]} if before else set()
            patterns |= {"2 " + " ".join(before)} if len(before) == 2 else set()
            items.append((i, a, b, text[a:b], patterns | ({"k " + key.group()} if key else set()), (a, b) in spans))
    edges = {}
    for _, _, _, value, patterns, seed in items:
        for p in patterns:
            edges[p, value] = edges.get((p, value), False) or seed
    seeds = {v: any(s for (_, w), s in edges.items() if w == v) for _, v in edges}
    trust = {v: float(s) for v, s in seeds.items()}
    for _ in range(rounds):
        strong = {}
        for p in {p for p, _ in edges}:
            own = [trust[v] for q, v in edges if q == p]
            if sum(t >= threshold for t in own) >= support:
                strong[p] = sum(own) / (len(own) + 1)
        trust = {v: 1.0 if s else max([strong[p] for (p, w), seed in edges.items() if w == v and not seed and p in strong], default=0.0) for v, s in seeds.items()}
    good = {v for v, t in trust.items() if not seeds[v] and t >= threshold}
    return [sorted((a, b) for j, a, b, value, _, seed in items if j == i and not seed and value in good) for i in range(len(texts))]
