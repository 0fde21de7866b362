"""Plain versions of the operators, without their methods."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

from xxhash import xxh64_intdigest

UPPER = {c: c + 32 for c in range(65, 91)}
BLANK = re.compile(r"[\x20\x09-\x0D]+")
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Texts that operators tend to trip over.
ODD = [
    None, "", " \n\t ", "\n\n", "a", "É", "123", "ab\x00cd\x1f e", "x" * 5000, "́ á ẛ̣ İΣ ΑΣ", "日本語 テキスト 🙂🙂",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "It's we'll I'D 'S ''s 12,345.67", "word " * 4000, "nbsp here there",
    "Licensed under CC BY-NC 4.0.", "under the MIT license under the mit license", "Apache License, Version 2", "a b c d e f g h i j k\n" * 3,
]


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def plain_words(text):
    return [w for w in NOT_WORD.split((text or "").translate(UPPER)) if w]


def quality(text):
    own = words(text)
    windows = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    own = [w for w in BLANK.split((text or "").translate(UPPER)) if w]
    grams = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, distance=2):
    """Least member of the component of every print."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def leaks(text, items, size=10):
    own = plain_words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        theirs = plain_words(item_text)
        n = min(size, len(theirs))
        for k in range(len(theirs) - n + 1 if theirs else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == theirs[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids.add(str(item))
    return len(own), len(hit), sorted(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
