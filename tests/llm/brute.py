"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(rows, k, num, den):
    """[(doc_id, n_shingles, component_id)] of [(doc_id, text)]."""
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    part = components(len(sets), links)
    ids = defaultdict(list)
    for i, p in enumerate(part):
        ids[p].append(rows[i][0])
    least = {p: min((x for x in v if x is not None), default=None) for p, v in ids.items()}
    return [(d, len(s), least[p] if s else d) for (d, _), s, p in zip(rows, sets, part, strict=True)]


def substrings(rows, width):
    """[(doc_id, n_words, n_removed, sha of the kept words)]."""
    large = float("inf")
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, large), large if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (large if d is None else d):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def line_runs(rows, least, long=None):
    """{(doc_id, text): text left} of distinct rows, in order of id, nulls last (rows that share an id share the text too).

    Runs have ``least`` lines, or fewer of more than ``long`` words together.
    """
    seqs = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1])):
        seqs.append((d, t, [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)]))
    seen, out = set(), {}
    for d, t, s in seqs:
        gone = set()
        for i in range(len(s)):
            for n in range(1 if long is not None else least, least + 1):
                key = tuple(x for _, x in s[i : i + n])
                if len(key) < n or n < least and sum(len(words(x)) for x in key) <= long:
                    continue
                if key in seen:
                    gone |= {j for j, _ in s[i : i + n]}
                seen.add(key)
        out[d, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return bins


def multiset(rows):
    return Counter(map(tuple, rows))
