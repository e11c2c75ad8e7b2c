"""Sequence reduction and diagrams against plain enumeration."""

import random
from collections import Counter
from itertools import combinations

from runlore.llm.subsequences import Diagrams, shorten


def subs(seq, k):
    return {c for n in range(1, k + 1) for c in combinations(seq, n)}


def test_shorten_keeps_short_subsequences():
    r = random.Random(5)
    for _ in range(400):
        k, size = r.randint(1, 4), r.randint(1, 4)
        seq = [r.randrange(size) for _ in range(r.randint(0, 14))]
        short = shorten(seq, k)
        assert subs(short, k) == subs(seq, k), (seq, short, k)
        cut = r.randint(0, len(seq))
        assert subs(shorten(shorten(seq[:cut], k) + shorten(seq[cut:], k), k), k) == subs(seq, k)


def test_shorten_is_bounded():
    assert len(shorten([0, 1, 2] * 50_000, 3)) < 60


def test_mining_matches_enumeration():
    r = random.Random(7)
    for _ in range(60):
        db = Counter(tuple(r.randrange(5) for _ in range(r.randint(0, 7))) for _ in range(25))
        d = Diagrams()
        got = dict(d.mine(d.build(list(db.items())), 4, 4))
        want = Counter()
        for s, w in db.items():
            for p in {p for p in subs(s, 4) if len(set(p)) == len(p)}:
                want[p] += w
        assert got == {p: n for p, n in want.items() if n >= 4}
