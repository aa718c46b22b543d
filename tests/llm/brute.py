"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, lower=True):
    words = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def paragraphs(text, radius=10, min_words=5):
    """[(piece, start, end)] of the runs of words between content-defined cuts."""
    prime = 2**31 - 1

    def number(word):
        raw = word.encode()
        h = len(raw)
        for b in raw[:8].ljust(8, b"\0"):
            h = (h * 257 + b) % prime
        return h * h % prime

    found = list(WORD.finditer((text or "").translate(LOWER)))
    own = [number(m.group()) for m in found] + [0]
    draw = [(own[i] * 48271 + own[i + 1] * 16807) % prime for i in range(len(found))]
    cuts = [i for i in range(radius + 1, len(found) - radius)
            if draw[i] < min(draw[i - radius:i]) and draw[i] <= min(draw[i + 1:i + radius + 1])]
    cuts = [0, *cuts, len(found)]
    return [(k, found[a].start(), found[b - 1].end()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b - a >= min_words]


class Union:
    def __init__(self):
        self.up = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


def linked_components(sets):
    """{name: smallest name of its component} under Jaccard >= 0.8 of {name: set}."""
    u, names = Union(), sorted(sets)
    for i, a in enumerate(names):
        u.top(a)
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    return {n: u.top(n) for n in names}


def later_lines(docs, min_words=5):
    """{(doc, line)} under a later copy of a run with min_words words."""
    first, windows = {}, []
    for doc in sorted(docs):
        lines = (docs[doc] or "").split("\n") if docs[doc] else []
        n = [len(WORD.findall(x)) for x in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(n[i:j + 1]) >= min_words:
                    windows.append((tuple(lines[i:j + 1]), doc, i, j))
    for content, doc, i, j in windows:
        first[content] = min(first.get(content, (doc, i)), (doc, i))
    return {(doc, k) for content, doc, i, j in windows if first[content] != (doc, i) for k in range(i, j + 1)}


def statistics(text):
    words = WORD.findall(text or "")
    seen, repeat = {}, set()
    for i in range(len(words) - 4):
        k = tuple(words[i:i + 5])
        if k in seen:
            repeat.update(range(i, i + 5), range(seen[k], seen[k] + 5))
        seen.setdefault(k, i)
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(lines.values()) - len(lines), len(repeat))


def base_secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, n, rx in (("access", 20, "AKIA[A-Z0-9]+"), ("hex", 24, "[0-9a-f]+")):
        for m in re.finditer(rx, text):
            if len(m[0]) >= n:
                found.append((m.start(), 1 if kind == "access" else 2, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]
