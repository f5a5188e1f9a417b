"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

from grainwise.llm import secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def smallest_reachable(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def near_duplicates(texts: list[tuple[int, str | None]]) -> dict[int, int]:
    """Component of every id; rows that share an id are one node."""
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((a, b))
    return smallest_reachable([i for i, _ in sets], links)


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(begin, kind, end), sorted."""
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        run = m[0]
        if re.search(secrets.ALLOWED, run):
            continue
        for part in re.split(secrets.ALLOWED_WORDS, run):
            if len(part) < 20 or not re.search("[0-9]", part) or not re.search("[A-Za-z]", part):
                continue
            windows = (part[i : i + 20] for i in range(len(part) - 19))
            entropy = max(-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in windows)
            least = next(bits for form, bits in secrets.CLASSES if re.search(form, part))
            if round(entropy, 9) >= least:
                out.append((m.start(), 3, m.end()))
                break
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{secrets.KINDS[kind]}:{begin}:{end}" for begin, kind, end in spans)


def scanned(text: str | None) -> tuple:
    spans = secret_spans(text)
    base = hashlib.sha256(listed([s for s in spans if s[1] < 3]).encode()).hexdigest()
    return (*(sum(s[1] == k for s in spans) for k in range(3)), base, listed(spans))


def masked(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for begin, _, end in secret_spans(text):
        if begin >= at:
            out += [text[at:begin], secrets.MASK]
        at = max(at, end)
    return "".join(out) + text[at:]
