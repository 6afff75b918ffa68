"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import make_docs
from turnlens.llm import spelling
from turnlens.llm.spelling import count_words, gathered, group_variants, levels, one_edit, search, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(n, ratio=10):
    out = {}
    for w in n:
        near = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(r, base, n):
    letters = "abcdeiostuéßÿ"
    out = set(base)
    while len(out) < n:
        w = r.choice(sorted(out))
        i, k = r.randrange(len(w)), r.random()
        out.add(w[:i] + w[i + 1:] if k < 0.3 else w[:i] + r.choice(letters) + w[i + (k < 0.7):])
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("most", [30_000, 40])
def test_as_all_pairs(spark, monkeypatch, most):
    """Also with nodes that are split by further levels and searched block by block."""
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    monkeypatch.setattr(spelling, "MOST_QUERIES", 10 * most)
    r = random.Random(most)
    words = variants(r, ["aboutside", "testicate", "usbestiod", "aaaaaaaa", "abababab", "a" * 70, "b" * 60 + "c", "dosécotÿ"], 500)
    words += ["".join(r.sample("abcdeist", 8)) for _ in range(60)]  # words of the same letters
    n = {w: int(10 ** (r.random() * 5)) + 2 for w in dict.fromkeys(words)}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    assert got(group_variants(table)) == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] and v[0] for v in want.values())


def test_words_of_documents(spark, edge_rows):
    r = random.Random(1)
    base = variants(r, ["aboutside", "testicate", "Usbestiod", "dosécotÿ"], 150)
    rows = list(edge_rows) + [(100 + i, " ".join(r.choice(base) for _ in range(300))) for i in range(20)]
    rows += [(200, "×÷×÷×÷× ABCDEFGÀ abcdefgÀ abcdefgà" * 2), (200, "l'été-dernière_dernière"), (None, "nullable nullable"), (None, None),
             (201, "x" * 6 + " " + "x" * 6)]
    docs = make_docs(spark, rows)
    n = brute_words(rows)
    assert {x["word"]: x["n"] for x in count_words(docs).collect()} == n
    assert got(spelling_variants(docs)) == brute(n)
    assert spelling_variants(docs.where("false")).count() == 0


def test_search_loses_no_pair_and_leaves_much_out(monkeypatch):
    r = random.Random(9)
    words = np.array(variants(r, ["aboutside", "testicate", "usbestiod", "occidents"], 800), dtype=object)
    counts = levels(list(words))
    order = np.lexsort(counts.T[::-1])
    words, counts = words[order], counts[order]
    no = np.zeros(len(words), bool)
    for leaf, small in ((16, 4096), (1, 1), (3, 64)):
        monkeypatch.setattr(spelling, "LEAF", leaf)
        monkeypatch.setattr(spelling, "SMALL", small)
        pairs = {(words[q], words[w]) for qs, ws in gathered(search(counts, counts, 0, no, no)) for q, w in zip(qs, ws)}
        near = {(a, b) for a in words for b in words if one_edit(a, b)}
        assert near <= pairs and len(pairs) < len(words) ** 2 / 20
    assert one_edit("abc", "abcd") and one_edit("abc", "xabc") and one_edit("abc", "axc") and one_edit("", "a")
    assert not one_edit("abc", "abc") and not one_edit("abc", "acb") and not one_edit("abc", "abcde")
