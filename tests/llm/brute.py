"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id -> (number of shingles, smallest id reachable)."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def edit_distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance of pattern to a part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text: str, luhn, kinds) -> list[tuple[int, int, str]]:
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], kinds.index(s[2])))


def kneser_ney(texts: list[str], order: int):
    """log P(byte | history) of an interpolated modified Kneser-Ney byte model, by the book."""
    import math

    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = b" " * (order - 1) + t
        for k in range(order - 1, len(padded)):
            grams[order][padded[k - order + 1 : k + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discounts = {}
    for n in range(1, order + 1):
        c = Counter(grams[n].values())
        n1, n2, n3, n4 = (max(1, c[k]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[n] = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    following: dict[bytes, dict[bytes, int]] = {}
    for counted in grams:
        for x, c in counted.items():
            following.setdefault(x[:-1], {})[x] = c

    def prob(g: bytes) -> float:
        n = len(g)
        if n == 0:
            return 1 / 256
        after = following.get(g[:-1])
        if not after:
            return prob(g[1:])
        total = sum(after.values())
        d = lambda c: discounts[n][min(c, 3) - 1]
        weight = sum(d(c) for c in after.values()) / total
        c = after.get(g, 0)
        return (c - d(c) if c else 0) / total + weight * prob(g[1:])

    return lambda g: math.log(prob(g))


def perplexities(train: list[str], held: list[str], asked: list[str], order: int, smoothing: int, quantile: float, margin: float, step: float):
    """(perplexity of each asked text, None without bytes; threshold) of one language."""
    import math

    fold = lambda t: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[\x20\x09-\x0D]+", " ", t))).lstrip(" ").encode()
    log_p = kneser_ney([fold(t) for t in train], order)

    def total(t: str) -> tuple[int, float]:
        padded = b" " * (order - 1) + fold(t)
        return len(padded) - order + 1, sum(log_p(padded[k : k + order]) for k in range(len(padded) - order + 1))

    sums = [s for t in held if (s := total(t))[0]]
    mean = sum(s for _, s in sums) / sum(n for n, _ in sums)
    smooth = lambda n, s: math.exp(-(s + smoothing * mean) / (n + smoothing))
    steps = sorted(round(smooth(*s) / step) for s in sums)
    at = quantile * (len(steps) - 1)
    low, high = steps[math.floor(at)], steps[math.ceil(at)]
    limit = (low + (high - low) * (at - math.floor(at))) * step * margin
    return [smooth(*total(t)) if total(t)[0] else None for t in asked], limit


def maximal_segments(score: list[float], low: int = 0, high: int | None = None) -> list[tuple[float, int, int]]:
    """The best segment, then those left and right of it (Ruzzo and Tompa's definition)."""
    high = len(score) if high is None else high
    best, found = 0.0, None
    for i in range(low, high):
        total = 0.0
        for j in range(i, high):
            total += score[j]
            if total > best + 1e-9:
                best, found = total, (i, j + 1)
    if found is None:
        return []
    i, j = found
    return maximal_segments(score, low, i) + [(best, i, j)] + maximal_segments(score, j, high)


def toxicity(text: str | None, cell, odds, drift: float, lam: float, log_k: float, curve, significant: float) -> tuple[float, int]:
    """(score, number of passages) of one text; cell gives a token's number, odds its log-odds."""
    import math
    import string

    tokens = []
    for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        bare = w.strip(string.punctuation) or w
        body = bare.encode()
        tokens.append(max(odds[cell(p)] for p in [body, *(body[:k] for k in (5, 6, 7) if len(body) > k)]) - drift)
    size = log_k + math.log(max(1, len(tokens)))
    levels = [lam * s - size for s, _, _ in maximal_segments(tokens)]
    over = [x for x in levels if x >= -math.log(significant)]
    a, b, c = curve
    return 1 / (1 + math.exp(-(a + b * max(levels, default=-size) + c * math.log1p(sum(over))))), len(over)


def failed_lines(text: str | None, rules) -> tuple[int, int]:
    """(failed lines, words in them) of the line rules, line by line."""
    failed = lost = 0
    for line in (text or "").split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        shouts = sum(sum("A" <= c <= "Z" for c in x) >= 2 and not any("a" <= c <= "z" for c in x) for x in w)
        low = re.sub("[A-Z\u00c0-\u00d6\u00d8-\u00de]", lambda m: m[0].lower(), line)
        bad = sum(c in "#*$%&|<>" for c in line) > rules.MAX_SYMBOLS * len(w)
        bad |= len(w) >= 3 and shouts > rules.MAX_CAPITALS * len(w)
        bad |= len(w) >= 6 and sum(a == b for a, b in zip(w, w[1:], strict=False)) > rules.MAX_RUN * len(w)
        bad |= len(w) >= rules.PUNCTUATION_WORDS and not any(x[-1] in rules.PUNCTUATION for x in w)
        bad |= len(w) >= rules.MENU_WORDS and all(re.match("[A-Z0-9]", x) for x in w) and not any(x[-1] in rules.PUNCTUATION for x in w)
        bad |= any(n.decode() in low for n in rules.NOTICES)
        failed += bad
        lost += bad * len(w)
    return failed, lost
