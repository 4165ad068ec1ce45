"""The operators' results, computed once more in the plainest way."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def similar(rows, percent=70):
    """doc_id -> (set size, links, smallest id reachable), over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = {i: set() for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, s in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(s), len(links[i]), min(seen))
    return out


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def shared_runs(rows, n=50):
    """doc_id -> words that lie in runs of n words that a smaller id has too."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        w = WORD.findall((text or "").translate(LOWER))
        grams = [tuple(w[a : a + n]) for a in range(len(w) - n + 1)]
        out[i] = set().union(*[range(a, a + n) for a, g in enumerate(grams) if g in seen])
        for g in grams:
            seen.setdefault(g, i)
    return out


def best_alignment(x, y, equal=0.2, other=-0.8):
    """The best local alignment of two lists of words, by all cells: score, start and end in x, columns and equal ones."""
    best = (0.0, 0, 0, 0, 0)
    before = [(0.0, 0, 0, 0)] * (len(y) + 1)  # score, start in x, columns, equal columns
    for i, a in enumerate(x):
        row = [(0.0, i + 1, 0, 0)]
        for j, b in enumerate(y):
            s, at, n, same = before[j]
            hit = a == b
            cell = (s + (equal if hit else other), at, n + 1, same + hit) if s > 0 or hit else (0.0, i + 1, 0, 0)
            if s <= 0 and hit:
                cell = (equal, i, 1, 1)
            for s, at, n, same in (before[j + 1], row[j]):
                if s + other > cell[0]:
                    cell = (s + other, at, n + 1, same)
            row.append(cell if cell[0] > 0 else (0.0, i + 1, 0, 0))
            if row[-1][0] > best[0]:
                best = (row[-1][0], row[-1][1], i + 1, row[-1][2], row[-1][3])
        before = row
    return best
