"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pii(text: str | None):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }
    joined = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return (*[len(v) for v in found.values()], hashlib.sha256(joined.encode()).hexdigest())


def counts(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    windows: dict = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) or frozenset([tuple(words)])


def components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable by links, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * (n := len(a & b)) >= 90 * (len(a) + len(b) - n):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}
