"""Array kernels against plain statements of the same definitions, row by row."""

import difflib
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests import refimpl as R
from turnlens.operators import arraykernels as AK


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def parent_plain(pred, ref, table, lam=0.5, smoothing=1e-5, orders=4):
    """PARENT from its formulas, one n-gram at a time."""
    known = {t for v in table for t in v}
    precision = recall = 1.0
    for n in range(1, orders + 1):
        p, r = grams(pred, n), grams(ref, n)
        entailed = {g: sum(t in known for t in g) / n for g in p | r}
        found = sum(min(c, r[g]) + (c - min(c, r[g])) * entailed[g] for g, c in p.items())
        part = found / p.total() if p else 0.0
        weight = sum(c * entailed[g] for g, c in r.items())
        back = sum(min(c, p[g]) * entailed[g] for g, c in r.items()) / weight if weight else 1.0
        precision *= (part or (smoothing if n > 1 else 0.0)) ** (1 / orders)
        recall *= (back or (smoothing if n > 1 else 0.0)) ** (1 / orders)
    in_table = sum(R.lcs(v, pred) / len(v) for v in table) / len(table)
    recall = recall ** (1 - lam) * (in_table or smoothing) ** lam
    return precision, recall, 2 * precision * recall / (precision + recall + 1e-8)


def lists(rows):
    return pa.array(rows, pa.list_(pa.string()))


def random_rows(r, n, most, letters="abcdefg"):
    return [[r.choice(letters) for _ in range(r.choice([0, 1, 2, r.randint(0, most)]))] for _ in range(n)]


@pytest.mark.parametrize("most", [8, 30, 90, 200])
def test_subsequences(most):
    r = random.Random(most)
    a, b = random_rows(r, 120, most), random_rows(r, 120, most)
    got = AK.common_subsequence(*AK.coded(lists(a), lists(b)))
    assert got.tolist() == [R.lcs(x, y) for x, y in zip(a, b)]
    n = next(k for k in range(120) if len(a[k]) > 2)
    assert AK.common_subsequence(*AK.coded(lists([None, a[n], ["x"] * 64, ["x"] * 65]), lists([["q"], a[n], ["x"] * 70, ["x"] * 64]))).tolist() \
        == [0, len(a[n]), 64, 64]


def test_long_texts_are_fast():
    r = random.Random(2)
    a, b = [[str(r.randint(0, 900)) for _ in range(5000)] for _ in range(2)]
    start = time.time()
    got = AK.common_subsequence(*AK.coded(lists([a]), lists([b])))[0]
    fast = time.time() - start
    prev = [0] * 1001
    start = time.time()
    for x in a[:200]:  # a twenty-fifth of the rows of a table, on a fifth of its width
        cur = [0]
        for j, y in enumerate(b[:1000]):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    table = (time.time() - start) * 125
    assert 300 < got < 2000 and fast < table / 5


@pytest.mark.parametrize("most", [6, 40])
def test_gram_overlap(most):
    r = random.Random(most)
    a, b = random_rows(r, 80, most, "abc"), random_rows(r, 80, most, "abc")
    x, y = AK.coded(lists(a), lists(b))
    weight = np.concatenate([np.isin(x.codes, x.codes[:1]), np.isin(y.codes, x.codes[:1])]).astype(float)
    first = next(t for row in a for t in row)
    for n, g in enumerate(AK.gram_overlap(x, y, 4, weight), 1):
        for i in range(80):
            p, q = grams(a[i], n), grams(b[i], n)
            w = {s: sum(t == first for t in s) / n for s in p | q}
            assert (g["a"][i], g["b"][i], g["both"][i]) == (p.total(), q.total(), (p & q).total())
            assert g["a_weight"][i] == pytest.approx(sum(c * w[s] for s, c in p.items()))
            assert g["both_weight"][i] == pytest.approx(sum(c * w[s] for s, c in (p & q).items()))


def test_parent():
    r = random.Random(4)
    pred, ref = random_rows(r, 200, 25), random_rows(r, 200, 25)
    tables = [[[r.choice("abcdefghij") for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 4))] for _ in range(200)]
    flat = [v for t in tables for v in t]
    rows = np.repeat(np.arange(200), [len(t) for t in tables])
    a, b, v = AK.coded(lists(pred), lists(ref), lists(flat))
    got = AK.parent_scores(a, b, v, rows, 0.5, 1e-5, 4)
    for i in range(200):
        want = parent_plain(pred[i], ref[i], tables[i])
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(got[i], want)), (pred[i], ref[i], tables[i])
    none = AK.coded(lists([]), lists([]), lists([]))
    assert AK.parent_scores(*none, np.zeros(0, np.int64), 0.5, 1e-5, 4).shape == (0, 3)


def test_matching_letters_as_the_standard_library():
    r = random.Random(8)
    texts = ["".join(r.choice("ab cé\U0001f600"[:n]) for _ in range(r.choice([0, 1, 3, 20, 60]))) for n in (2, 4, 6) for _ in range(60)]
    pairs = [(r.choice(texts), r.choice(texts)) for _ in range(600)] + [("", ""), ("", "a"), ("x" * 3000, "x" * 2999 + "y")]
    pairs += [(t, t[:5] + "q" + t[5:]) for t in texts[:60]]
    a, b = (AK.letters(pa.array(list(side))) for side in zip(*pairs))
    want = [sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in pairs]
    assert AK.matching_letters(a, b).tolist() == want
    ratio = [int(round(100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio())) for x, y in pairs]
    assert AK.similarity(a, b).tolist() == ratio
    assert AK.similarity(a, b, 91).tolist() == [v if v >= 91 else 0 for v in ratio]
    old = AK.CELLS
    try:
        AK.CELLS = 50
        assert AK.matching_letters(a, b).tolist() == want
    finally:
        AK.CELLS = old
