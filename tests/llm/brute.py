"""Plain versions of the operators, written for clarity over small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(BLANK, text or "")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_duplicates(rows, percent=75):
    """{doc_id: (n_shingles, component)} of rows (doc_id, text)."""
    sets = {d: shingles(t) for d, t in rows}
    groups = Groups(sets)
    ids = sorted(sets)
    lists = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            lists[s].append(d)
    for a, b in {(x, y) for own in lists.values() for k, x in enumerate(own) for y in own[k + 1 :]}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            groups.join(a, b)
    return {d: (len(sets[d]), groups.find(d)) for d in ids}


def remove_repeats(rows, width=50):
    """{doc_id: (n_words, n_removed, sha256)}."""
    own = {d: words(t) for d, t in rows}
    first = {}
    for d in sorted(own):
        for p in range(len(own[d]) - width + 1):
            first.setdefault(tuple(own[d][p : p + width]), d)
    out = {}
    for d, w in own.items():
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < d:
                keep[p : p + width] = [False] * width
        kept = [x for x, k in zip(w, keep) if k]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def dedup_lines(rows, threshold=2, least=24):
    """{doc_id: (dropped line numbers, n_exact, n_links)}."""
    least = max(least, threshold + 1)
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= least or words(x)]
    first = {}
    for d, i, x in sorted(lines):
        first.setdefault(x, (d, i))
    by_size = defaultdict(list)
    for x in first:
        if len(x) >= least:  # shorter lines have no links
            by_size[len(x)].append(x)
    letters = {x: Counter(x) for x in first}
    links = defaultdict(list)
    for n in by_size:
        for m in range(n, n + threshold + 1):
            for x in by_size[n]:
                for y in by_size.get(m, []):
                    if (n < m or x < y) and sum(((letters[x] - letters[y]) | (letters[y] - letters[x])).values()) <= 2 * threshold and levenshtein(x, y) <= threshold:
                        links[x].append(y)
                        links[y].append(x)
    out = {d: ([], 0, 0) for d, _ in rows}
    for d, i, x in sorted(lines):
        drop, exact, n = out[d]
        if (d, i) > min([first[x], *(first[y] for y in links[x])]):
            drop.append(i)
        out[d] = (drop, exact + ((d, i) > first[x]), n + len(links[x]))
    return out


def base_measures(text):
    w = words(text)
    text = text or ""
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def cosine_links(rows, cosine=0.93):
    """{vec_id: (n_links, component)} of rows (vec_id, vector, label)."""
    import numpy as np

    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    groups = Groups([r[0] for r in rows])
    count = Counter()
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[i + 1 :]:
            if x is not None and x == y and sound(v) and sound(w) and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine:
                    count[a] += 1
                    count[b] += 1
                    groups.join(a, b)
    return {r[0]: (count[r[0]], groups.find(r[0])) for r in rows}
