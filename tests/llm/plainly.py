"""Plain re-computations that the corpus tests compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    t = text or ""
    spans = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    spans += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end(), "card"))
    for m in PHONE.finditer(t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end(), "phone"))
    spans.sort()
    text_form = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    c = Counter(x[3] for x in spans)
    return c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(text_form.encode()).hexdigest()


def quality(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(grams)
    covered = {p for i, g in enumerate(grams) if c[g] > 1 for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(t.count(x) for x in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def personal_spans(text: str | None) -> list[tuple]:
    t = text or ""
    spans = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    spans += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end(), "card"))
    spans += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def targets(sizes: dict, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            return got | {s: left * w[s] / total for s in open_}
        for s in full:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= full
    return got


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def jaccard(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def near_classes(rows: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """(key, class, copy_of, links, linked documents) of each row, by comparing all distinct sets."""
    members: dict[frozenset, list] = {}
    for k, t in rows:
        members.setdefault(shingle_set(t), []).append(k)
    sets = list(members)
    least = [min((k for k in members[s] if k is not None), default=None) for s in sets]
    part, links = list(range(len(sets))), [set() for _ in sets]

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                links[i].add(j)
                links[j].add(i)
                part[find(i)] = find(j)
    heads: dict[int, list] = {}
    for i in range(len(sets)):
        heads.setdefault(find(i), []).append(least[i])
    out = []
    for i, s in enumerate(sets):
        head = min((k for k in heads[find(i)] if k is not None), default=None)
        for k in members[s]:
            out.append((k, head, least[i], len(links[i]), sum(len(members[sets[j]]) for j in links[i]) + len(members[s]) - 1))
    return out


def repeated_runs(rows: list[tuple], n: int) -> list[tuple]:
    """(key, start, end) in code points of the longest runs in which every *n* words on end stand in two or more rows."""
    places = [[(m.start(), m.end()) for m in WORD.finditer(t or "")] for _, t in rows]
    owners: dict[tuple, set] = {}
    for i, (_, t) in enumerate(rows):
        words = WORD.findall(t or "")
        for j in range(len(words) - n + 1):
            owners.setdefault(hash(tuple(words[j : j + n])), set()).add(i)
    out = []
    for i, (k, t) in enumerate(rows):
        words = WORD.findall(t or "")
        begin = None
        for j in range(len(words) - n + 2):
            shared = j <= len(words) - n and len(owners[hash(tuple(words[j : j + n]))]) > 1
            if shared and begin is None:
                begin = j
            if not shared and begin is not None:
                out.append((k, places[i][begin][0], places[i][j + n - 2][1]))
                begin = None
    return out


def recall(runs: list[tuple], spans: list[tuple]) -> float:
    """Share of the runs of which at least half is inside the spans."""
    by: dict = {}
    for k, a, b in spans:
        by.setdefault(k, []).append((a, b))
    met = 0
    for k, a, b in runs:
        inside = 0
        at = a
        for s, e in sorted(by.get(k, [])):
            inside += max(0, min(e, b) - max(s, at))
            at = max(at, min(e, b))
        met += inside >= 0.5 * (b - a)
    return met / max(1, len(runs))
