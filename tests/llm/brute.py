"""Plain loops that state what the operators should give."""

from __future__ import annotations

import hashlib
import re

import numpy as np

BASE_PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def personal(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place, kind, end)."""
    out = []
    for place, (kind, pattern) in enumerate(BASE_PERSONAL):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((m.start(), place, kind, m.end()))
    return sorted(out)


def redacted(text: str, spans) -> str:
    out, at = [], 0
    for start, _, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(docs: list[tuple[int, str | None]], length: int) -> dict[int, list[str]]:
    """Words that stay, by id."""
    split = {i: words(t) for i, t in docs}
    first: dict[tuple, tuple] = {}
    for i in sorted(split):
        for s in range(len(split[i]) - length + 1):
            first.setdefault(tuple(split[i][s : s + length]), (i, s))
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (i, s):
                gone |= set(range(s, s + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def item_words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(docs, items, window: int = 13) -> dict[int, tuple[int, int, list[str]]]:
    """(words, hit words, sorted items) by id."""
    wanted: dict[tuple, set[str]] = {}
    for item, text in items:
        w = item_words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    out = {}
    for i, text in docs:
        w = item_words(text)
        hit, named = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    named |= found
        out[i] = (len(w), len(hit), sorted(named))
    return out


def components(fps: list[list[int]], ids: list[int], distance: int) -> list[int]:
    """Smallest id reachable over links of any fingerprint."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bits = np.array(fps, np.int64).reshape(len(ids), -1).view(np.uint64)
    for i in range(len(ids)):
        near = (np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance).any(axis=1)
        for j in np.flatnonzero(near):
            root[find(i + 1 + int(j))] = find(i)
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint by counting bit for bit."""
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    parts = [w] if len(w) < shingle else [w[i : i + shingle] for i in range(len(w) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def bootstrapped(docs, settings) -> dict[int, list[tuple[int, str, int]]]:
    """(start, kind, end) of seeds and discovered spans by id, with a scored graph in plain dicts."""
    import math

    from curatrix.llm import pii_bootstrap as P

    rows = []  # id, kind, start, end, found, before, after
    for i, text in docs:
        text = text or ""
        good = {(a, k, b) for a, _, k, b in personal(text)}
        patterns = {k: p.pattern for k, p in BASE_PERSONAL} | {"candidate": P.CANDIDATE}
        here = []
        for kind, pattern in patterns.items():
            found = list(re.finditer(pattern, text))
            parted = [text[x:y] for x, y in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)], strict=True)]
            left = [" ".join(x for pair in zip(parted[: n + 1], [*(m.group() for m in found[:n]), ""], strict=True) for x in pair) for n in range(len(found))]
            right = [" ".join(x for pair in zip(parted[n + 1 :], [*(m.group() for m in found[n + 1 :]), ""], strict=True) for x in pair) for n in range(len(found))]
            for n, m in enumerate(found):
                start, end, string = m.start(), m.end(), m.group()
                if kind == "candidate":
                    tail = re.search(settings.trailing, string)
                    lead = len(re.match(r"[\"'(<\[]*", string).group())
                    start, end = start + lead, end - (len(tail.group()) if tail else 0)
                    string = re.sub(r"^[\"'(<\[]*", "", re.sub(settings.trailing, "", string))
                    if len(string) < 5:
                        continue
                elif (start, kind, end) not in good:
                    continue
                here.append((i, kind, start, end, string, left[n], right[n]))
        seeds = [(r[2], r[3]) for r in here if r[1] != "candidate"]
        rows += [r for r in here if r[1] != "candidate" or not any(a < r[3] and r[2] < b for a, b in seeds)]

    def contexts(before, after):
        w, v = (words(re.sub("[0-9]", "0", x).lower()) for x in (before, after))
        out = set()
        if len(w) >= 2:
            out.add("2 " + " ".join(w[-2:]))
        if len(w) >= 3:
            out.add("3 " + " ".join(w[-3:]))
        if w and v:
            out.add(f"b {w[-1]} _ {v[0]}")
        return out

    members: dict[str, set[str]] = {}
    for _, _, _, _, found, before, after in rows:
        for p in contexts(before, after):
            members.setdefault(p, set()).add(found)
    seeds = {(r[4], r[1]) for r in rows if r[1] != "candidate"}
    named = {s for s, _ in seeds}
    kinds = [k for k, _ in BASE_PERSONAL]
    scores: dict[tuple[str, str], float] = {}
    rounds = iter(int, 1) if settings.rounds is None else range(settings.rounds)
    for _ in rounds:
        held = {**dict.fromkeys(seeds, 1.0), **scores}
        doubt: dict[tuple[str, str], float] = {}
        for m in members.values():
            for k in kinds:
                if sum((x, k) in seeds for x in m) >= settings.least_seeds:
                    confidence = sum(held.get((x, k), 0.0) for x in m) / len(m)
                    if confidence >= settings.confident:
                        for x in m - named:
                            doubt[x, k] = doubt.get((x, k), 0.0) + math.log(max(1 - confidence, 1e-6))
        before, scores = scores, {at: 1 - math.exp(d) for at, d in doubt.items()}
        if settings.rounds is None and {a: round(x, 6) for a, x in before.items()} == {a: round(x, 6) for a, x in scores.items()}:
            break
    best: dict[str, tuple] = {}
    for (x, k), s in scores.items():
        if s >= settings.accept:
            best[x] = min(best.get(x, (1.0, 9, "")), (-s, kinds.index(k), k))
    out = {i: [] for i, _ in docs}
    order = [*kinds, *(P.FOUND + k for k in kinds)]
    for i, kind, start, end, found, _, _ in rows:
        if kind != "candidate":
            out[i].append((start, order.index(kind), kind, end))
        elif found in best:
            name = P.FOUND + best[found][2]
            out[i].append((start, order.index(name), name, end))
    return {i: [(a, k, b) for a, _, k, b in sorted(x)] for i, x in out.items()}
