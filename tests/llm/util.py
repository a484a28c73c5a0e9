"""Brute-force counterparts of the operators."""

import collections
import itertools
import random
import re
import string

WORD = "[^\x20\x09-\x0D]+"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(WORD, text or "")


def shingles(text, n=5):
    w = words((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(texts, percent):
    """{id: text} to {id: least id reachable by links}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= percent * either:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}, sets


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copy(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, empty, short and repeated ones."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out[i] = out[rng.choice(sorted(out))]
        elif kind == 1 and out:
            out[i] = near_copy(rng, out[rng.choice(sorted(out))] or "a b c d e f", rng.randrange(1, 4))
        elif kind == 2:
            out[i] = rng.choice(["", "  \n", "one", "One two", "a b c d", "A b C d"])
        else:
            out[i] = prose(rng, rng.randrange(20, 150))
    return out


def repeated(texts, n=50):
    """{id: text} to {id: set of word positions in n-word windows that another text has}."""
    held = collections.defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    out = {}
    for i, t in texts.items():
        w = words(t)
        at = {x for k in range(len(w) - n + 1) if len(held[tuple(w[k : k + n])]) > 1 for x in range(k, k + n)}
        if at:
            out[i] = at
    return out
