"""Plain reference computations for the tests."""

import re


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def jaccard_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}
