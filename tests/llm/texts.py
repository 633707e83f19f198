"""Made-up prose and brute-force near-duplicates for the tests."""

import random
from collections import defaultdict

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def shingle_sets(plain):
    out = []
    for _, t in plain:
        w = t.encode().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    return out


def groups_by_hand(plain):
    sets = shingle_sets(plain)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            same = sets[a] == sets[b]
            if same or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
                if not same:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    least = {}
    for k, (i, _) in enumerate(plain):
        r = root(k)
        old = least.get(r)
        least[r] = i if old is None else old if i is None else min(i, old)
    return [(i, least[root(k)], len(links[k])) for k, (i, _) in enumerate(plain)]
