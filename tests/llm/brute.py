"""Plain versions of what the operators compute, for small inputs."""

import re
import string

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_classes(rows, threshold=0.8):
    """[(id, class id, links)] of [(id, text)], every row by itself."""
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                near[i][j] = near[j][i] = both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    return [(r[0], ids[x], sum(near[i])) for i, (r, x) in enumerate(zip(rows, label))]


def leaks(text, items, window=10):
    """(words, hit words, items) of a text against [(item id, text)]."""
    w, hit, found = words(text), set(), set()
    for item, phrase in items:
        p = words(phrase)
        n = min(window, len(p))
        phrases = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in phrases and item is not None:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)
