"""BLEU-4, ROUGE-L and METEOR of two texts in plain Python, for tests."""

from __future__ import annotations

import math
import re
from collections import Counter

from loomstrata.functions.overlap import stem


def bleu4(text: str, reference: str) -> float:
    h, r = text.split(), reference.split()
    if not set(h) & set(r):
        return 0.0
    logs, k = [], 1
    for n in range(1, 5):
        mine, theirs = (Counter(zip(*(w[i:] for i in range(n)))) for w in (h, r))
        hits, total = sum((mine & theirs).values()), max(1, sum(mine.values()))
        p = hits / total
        if not hits and len(h) > 1:
            p, k = 1 / (2**k * 5 / math.log(len(h))) / total, k + 1
        if p > 0:
            logs.append(math.log(p) / 4)
    return (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(logs))


def common(h: list[str], r: list[str]) -> int:
    table = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
    for i, a in enumerate(h):
        for j, b in enumerate(r):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def rouge_l(text: str, reference: str) -> float:
    h, r = ([stem(x) if len(x) > 3 else x for x in re.findall("[a-z0-9]+", t.lower())] for t in (text, reference))
    n = common(h, r)
    return 2 * n / (len(h) + len(r)) if n else 0.0


def meteor(text: str, reference: str, senses: dict[str, set[str]] | None = None) -> float:
    h, r = [*enumerate(text.lower().split())], [*enumerate(reference.lower().split())]
    nh, nr, pairs = len(h), len(r), []
    same = [lambda a, b: a == b, lambda a, b: stem(a) == stem(b)]
    if senses:
        same.append(lambda a, b: a == b or bool(senses.get(a, set()) & senses.get(b, set())))
    for fits in same:
        for i, a in h[::-1]:
            for j, b in r[::-1]:
                if fits(a, b):
                    pairs.append((i, j))
                    h.remove((i, a))
                    r.remove((j, b))
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, q = len(pairs) / nh, len(pairs) / nr
    return p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (chunks / len(pairs)) ** 3)
