"""A plain Katz model over Python dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

from quern.llm import katz

END = object()


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def ratio(n):
    d, flat = {}, min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    common = (katz.K + 1) * n[katz.K + 1] / n[1] if n[1] else 1.0
    for r in range(1, katz.K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        d[r] = x if 0 < x < 1 else (r - flat) / r
    return lambda c: d.get(c, 1.0)


class Model:
    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.c1 = Counter(t for x in train for t in x)
        self.n = sum(self.c1.values())
        self.c2 = defaultdict(Counter)
        for x in train:
            for h, w in zip([END, *x], x):
                self.c2[h][w] += 1
        self.d1 = ratio(Counter(self.c1.values()))
        self.d2 = ratio(Counter(c for x in self.c2.values() for c in x.values()))
        low = any(c <= katz.K for c in self.c1.values())
        self.s1 = 1 if low else self.n / (self.n + 1) if self.n else 1
        self.unk = 1 - sum(self.p1(w) for w in self.c1)
        self.back = {}
        for h, x in self.c2.items():
            total = sum(x.values())
            s = 1 if any(c <= katz.K for c in x.values()) else total / (total + 1)
            left = 1 - sum(s * self.d2(c) * c / total for c in x.values())
            self.back[h] = s, total, left / (1 - sum(self.p1(w) for w in x))

    def p1(self, w):
        c = self.c1.get(w, 0)
        return self.s1 * self.d1(c) * c / self.n if c else self.unk

    def p(self, w, h):
        if h not in self.back:
            return self.p1(w)
        s, total, alpha = self.back[h]
        c = self.c2[h].get(w, 0)
        return s * self.d2(c) * c / total if c else alpha * self.p1(w)

    def score(self, text):
        x = tokens(text)
        base = sum(math.log10((self.c1.get(w, 0) + 1) / (self.n + len(self.c1) + 1)) for w in x)
        return len(x), sum(w in self.c1 for w in x), base, sum(math.log10(self.p(w, h)) for h, w in zip([END, *x], x))
