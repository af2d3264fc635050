"""Plain versions of the operators' contracts."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def base_counts(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def windows(docs, size=13):
    lists, first = [WORD.findall(t or "") for _, t in docs], {}
    for (d, _), w in zip(docs, lists):
        for i in range(len(w) - size + 1) if d is not None else ():
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, lists):
        gone = set()
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def byte_repeats(texts, size=400):
    """Per text, which bytes go."""
    data, times = [(t or "").encode() for t in texts], Counter()
    for b in data:
        times.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for b in data:
        reach, gone = 0, bytearray(len(b))
        for i in range(len(b)):
            if i <= len(b) - size and times[b[i : i + size]] > 1:
                reach = i + size
            gone[i] = i < reach
        out.append(gone)
    return out


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def shingles(text, size=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


PAD = 0x110000


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of three code points -> a function from a text to its log perplexity."""
    grams = lambda t: [tuple(p[i : i + 3]) for p in [[PAD, PAD, *map(ord, t)]] for i in range(len(t))]
    c3 = Counter(g for t in texts for g in grams(t))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)

    def order(c, lower):
        k = [sum(n == i for n in c.values()) for i in range(1, 5)]
        if min(k) > 0:
            y = k[0] / (k[0] + 2 * k[1])
            d = [max(0.05, min(i + 0.95, i + 1 - (i + 2) * y * k[i + 1] / k[i])) for i in range(3)]
        else:
            d = [0.5, 0.75, 0.9]
        taken = {g: d[min(n, 3) - 1] for g, n in c.items()}
        total, off = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            off[g[:-1]] += taken[g]
        share = {ctx: off[ctx] / total[ctx] for ctx in total}
        return lambda g: (c[g] - taken[g]) / total[g[:-1]] + share[g[:-1]] * lower(g[1:]) if g in c else share.get(g[:-1], 1.0) * lower(g[1:])

    unseen = 1 / (len(c1) + 1)
    p1 = order(c1, lambda g: unseen)
    one = lambda g: p1(g) if g in c1 else unseen
    p3 = order(c3, order(c2, one))
    return lambda t: -sum(math.log(p3(g)) for g in grams(t)) / len(t)


def quantile(values, q):
    """The least of the values that at least this share of them reaches up to."""
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def witten_bell(urls, symbol, symbols, order):
    """Log probability of each symbol of a url behind the `order` - 1 before it, each order leaning on the next shorter one."""
    counts, kinds = Counter(), Counter()
    for u in urls:
        s = [0] * (order - 1) + [symbol(c) for c in u]
        for i in range(order - 1, len(s)):
            for k in range(order):
                g = tuple(s[i - k : i + 1])
                kinds[g[:-1]] += g not in counts
                counts[g] += 1
    totals = Counter()
    for g, n in counts.items():
        totals[g[:-1]] += n

    def p(g):
        lower = 1 / symbols if len(g) == 1 else p(g[1:])
        t, k = totals[g[:-1]], kinds[g[:-1]]
        return (counts[g] + k * lower) / (t + k) if t else lower

    def logs(u):
        s = [0] * (order - 1) + [symbol(c) for c in u]
        return [math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]

    return logs
