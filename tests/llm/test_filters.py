"""The bounds that the similarity join prunes by never cut a true link."""

import random

import numpy as np

from docloom.llm import jaccard


def test_parities_never_exceed_what_sets_do_not_share():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice((1, 5, 60, 600, 3000))
        base = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        x = np.unique(base[: n - rng.randrange(n)])
        y = np.unique(np.concatenate([base[rng.randrange(n) :], np.array([rng.getrandbits(64) for _ in range(rng.randrange(40))], dtype=np.uint64)]))
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        assert jaccard._apart(jaccard._wide(x), jaccard._wide(y)) <= apart
        narrow = jaccard._apart(jaccard._parities(x), jaccard._parities(y))
        assert narrow <= apart
        assert jaccard._apart(jaccard._wide(x), jaccard._parities(y)) == narrow


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(1, 60)
        x = set(rng.sample(range(500), n))
        y = set(x)
        for _ in range(rng.randrange(4)):
            y.discard(rng.choice(sorted(x)))
            y.add(rng.randrange(500))
        if 100 * len(x & y) >= 85 * len(x | y):
            first = lambda s: set(sorted(s)[: jaccard.prefix_length(len(s), 85)])
            assert first(x) & first(y)
            assert len(x & y) >= jaccard.overlap_needed(len(x), len(y), 85)


def test_short_texts_are_one_shingle():
    a, b, c, d, e = jaccard.shingle_sets(["one two", "ONE\ttwo", "two one", "", "a b c d e a b c d"])
    assert a.tolist() == b.tolist() != c.tolist() and len(a) == 1 and len(d) == 0 and len(e) == 5
