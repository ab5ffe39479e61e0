"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

SECRET_RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PII_RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(_digits(m[0])) <= 15),
]


def base_spans(text: str | None, rules) -> list[tuple[int, int, str, int]]:
    out = [(m.start(), k, kind, m.end()) for k, (kind, rule, ok) in enumerate(rules) for m in rule.finditer(text or "") if ok(m)]
    return sorted(out)


def base_digest(text: str | None, rules) -> str:
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base_spans(text, rules)).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, k: int = 5) -> set:
    w = words(text)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        met: dict[int, int] = {}
        for x in s:
            for m in where[x]:
                if m > k:
                    met[m] = met.get(m, 0) + 1
        for m, common in met.items():
            j, r = sets[m]
            if 100 * common >= 75 * (len(s) + len(r) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def norm_tokens(text: str | None) -> list[str]:
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def overlaps(text: str | None, items: dict[int, str], masks, window: int, share: float) -> list[int]:
    """Benchmark items that share a spaced seed with the text and overlap it well enough there."""
    import math

    a, found = norm_tokens(text), []
    span = len(masks[0])

    def seeds(t):
        return [((k, *(t[s + i] for i, c in enumerate(m) if c == "1")), s) for k, m in enumerate(masks) for s in range(len(t) - span + 1)]

    mine: dict = {}
    for key, s in seeds(a):
        mine.setdefault(key, []).append(s)
    for item, t in items.items():
        b = norm_tokens(t)
        w, best = min(window, len(b)), -1
        for off in {s - at for key, at in seeds(b) for s in mine.get(key, ())}:
            same = [a[p] == b[p - off] for p in range(max(0, off), min(len(a), off + len(b)))]
            best = max([best, *(sum(same[s : s + w]) for s in range(len(same) - w + 1))])
        if best >= math.ceil(round(w * share, 9)):
            found.append(item)
    return sorted(found)


def ftrl(rows: list[dict], targets: list[list[float]], order: list[list[int]], *, alpha: float, beta: float, l1: float, l2: float, free: set, outputs: int, link) -> list[dict]:
    """Weights by feature, an output each, of follow-the-regularised-leader, a
    number at a time.  ``rows``: feature -> value; ``targets``: a row each;
    ``order``: the rows of each epoch; ``free``: features without L1."""
    z: list[dict] = [{} for _ in range(outputs)]
    n: list[dict] = [{} for _ in range(outputs)]

    def weight(k, f):
        v, pen = z[k].get(f, 0.0), 0.0 if f in free else l1
        if abs(v) <= pen:
            return 0.0
        return -(v - (pen if v > 0 else -pen)) / ((beta + n[k].get(f, 0.0) ** 0.5) / alpha + l2)

    for epoch in order:
        for r in epoch:
            w = [{f: weight(k, f) for f in rows[r]} for k in range(outputs)]
            p = link([sum(w[k][f] * v for f, v in rows[r].items()) for k in range(outputs)])
            for k in range(outputs):
                for f, v in rows[r].items():
                    g = (p[k] - targets[r][k]) * v
                    was = n[k].get(f, 0.0)
                    n[k][f] = was + g * g
                    z[k][f] = z[k].get(f, 0.0) + g - (n[k][f] ** 0.5 - was**0.5) / alpha * w[k][f]
    return [{f: weight(k, f) for f in z[k]} for k in range(outputs)]
