"""METEOR's alignment: the same scores as going through all states, with the work of a pattern done once."""

import random
from itertools import combinations, permutations

from turnlens.operators import meteor as M


def fewest_chunks(hyp, ref):
    """Chunks of the best of all matchings with as many pairs as can be."""
    most = sum(min(hyp.count(w), ref.count(w)) for w in set(hyp))
    return min(M.chunks_of(dict(zip(i, j))) for i in combinations(range(len(hyp)), most) for j in permutations(range(len(ref)), most)
               if all(hyp[a] == ref[b] for a, b in zip(i, j)))


def test_fewest_chunks_of_all_matchings():
    r = random.Random(5)
    for _ in range(150):
        hyp, ref = ([r.choice("abc") for _ in range(r.randint(1, 6))] for _ in "hr")
        if set(hyp) & set(ref):
            pairs = M.align_stage(hyp, ref, {})
            assert len(pairs) == sum(min(hyp.count(w), ref.count(w)) for w in set(hyp))
            assert M.chunks_of(pairs) == fewest_chunks(hyp, ref)


def test_later_stages_keep_earlier_pairs():
    hyp, ref = "x a b a u v".split(), "a b y a u v".split()
    first = M.align_stage(hyp, ref, {})
    both = M.align_stage([w if w in "xy" else None for w in hyp], ["x" if w == "y" else None for w in ref], first)
    assert first.items() <= both.items() and both[0] == 2 and M.align_stage(hyp, ref, both) == both


def test_work_is_done_once_for_a_pattern():
    M.best_pairs.cache_clear()
    for i in range(50):
        M.meteor_one(f"The brand is b{i} . The count is c{i} .", f"Its brand is b{i} . Its count is c{i} .")
    assert M.best_pairs.cache_info().misses == 1
    text = " ".join(f"The s{i} is v{i} ." for i in range(8))
    assert M.align_stage(text.split(), text.split(), {}) == {i: i for i in range(40)}
