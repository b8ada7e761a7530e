"""Plain single-process versions of the operators, to hold their results against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_list(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def components(rows, percent=75):
    """rows: (doc_id, text); returns {doc_id: smallest id reachable}."""
    sets = [(i, set(shingle_list(t))) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for sh in s:
            where.setdefault(sh, []).append(k)
    common = Counter()
    for ks in where.values():
        common.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :])
    for (a, b), n in common.items():
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * n >= percent * (len(x) + len(y) - n):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return {i: find(i) for i in root}
