"""Plain versions of what the operators compute."""

import collections
import re


def jaccard_components(rows, width, num, den):
    """doc_id -> (shingles, component) of rows (doc_id, text) with distinct ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    holders, root = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def auc(scores, labels):
    ranked = sorted(zip(scores, labels))
    good = sum(labels)
    below = total = 0
    for _, y in ranked:
        if y:
            total += below
        else:
            below += 1
    return total / max(1, good * (len(labels) - good))
