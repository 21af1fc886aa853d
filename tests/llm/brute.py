"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
_DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def words(text, lower=False):
    return WORD.findall((text or "").translate(_DOWN) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, live = {}, share * sum(sizes.values()), {s for s in sizes if sizes[s]}
    out |= {s: 0.0 for s in sizes if not sizes[s]}
    while live:
        level = left / sum(weight[s] for s in live)
        over = [s for s in live if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in live}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            live.remove(s)
    return out


def substring(rows, size=20):
    """{doc_id: (n_words, n_removed, sha)}; ids must be unique."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i: i + size])
            if key in seen:
                gone[i: i + size] = [True] * size
            seen.add(key)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def language_base(rows):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base)] in order."""
    texts = [(d, [*words(t, True), None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    c = Counter(x for (_, w), h in zip(texts, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for (d, w), h in zip(texts, held)]


def _fits(kind, s):
    d = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
    return kind == "email" or 12 <= len(d) <= 19 and total % 10 == 0


def spans(text):
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if _fits(name, m[0])]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def jaccard(rows, size, p, q):
    """[(doc_id, n, component, links to other sets)] in order."""
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append(frozenset(tuple(w[i: i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                head[max(find(i), find(j))] = min(find(i), find(j))
                if a != b:
                    links[a].add(b)
                    links[b].add(a)
    smallest = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        smallest[r] = d if smallest.get(r) is None else min(smallest[r], d) if d is not None else smallest[r]
    return [(d, len(s), smallest[find(k)], len(links[s]) if s else 0) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def quality(text):
    w = words(text)
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), again, len(covered)


def lines(rows, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(_DOWN)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 << 63 if d is None else d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (-1 << 63 if d is None else d)]
        out.append((d, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def repeated_words(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def word_runs(w, least=12):
    """Every (start, length, period), by trying all periods."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, n = i - q, j - i + q
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k - r] for k in range(start + r, start + n)) for r in range(1, q)):
                out.append((start, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rows, least=12):
    out = []
    for d, t in rows:
        w = repeated_words(d, t)
        found = word_runs(w, least)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left)))
    return out


def resample_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_DOWN))


def resampled(rows, target, percent=25, min_words=20, seed=7):
    features = lambda t: [*(w := resample_words(t)), *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    place = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(place(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    s_all, t_all = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in range(10_000)]
    out = []
    for d, x in rows:
        f = features(x)
        weight = sum(gain[place(y)] for y in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(resample_words(x)) >= min_words))
    order = sorted((k for k in range(len(out)) if out[k][4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    drawn = {k: n for n, k in enumerate(order[: percent * len(order) // 100], 1)}
    return [(*x[:4], drawn.get(k)) for k, x in enumerate(out)]
