"""The n-gram Jaccard join against all pairs, and its parts."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import make_docs
from turnlens.llm import ngram_join
from turnlens.llm.components import connected, hot_keys, looked_up
from turnlens.llm.ngram_join import Bands, shingle_set, similar_classes, verify_group, word_hashes


def shingles(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    """(id, set size, class) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, len(s), low.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def brute_links(rows, n, percent):
    """(id, set size, class, other rows linked with) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    counts = [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets))
              for i, a in enumerate(sets)]
    out = [(k, len(a), c) for (k, _), a, c in zip(rows, sets, counts)]
    return sorted(out, key=str)


def near_copies(seed, groups, size):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    rows, k = [], 1000
    passage = [r.choice(words) for _ in range(40)]
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([4, 14, 40, 90, 200]))] + passage * (g % 2)
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
            if r.random() < 0.5:  # a chain: the next copy starts from this one
                base = copy
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_as_all_pairs(spark, edge_rows, n, percent):
    rows = edge_rows + near_copies(n, 18, 14) + near_copies(n + 1, 1, 90)
    got = sorted(map(tuple, similar_classes(make_docs(spark, rows), n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 300)
    rows = near_copies(11, 6, 30)
    got = sorted(map(tuple, similar_classes(make_docs(spark, rows), 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("group", [300, 500_000])
@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_links_as_all_pairs(spark, edge_rows, monkeypatch, n, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group)
    rows = [r for r in edge_rows if len(r[1] or "") < 10_000] + near_copies(n, 9, 10) + near_copies(n + 1, 1, 30)
    rows += rows[-70:-40]  # rows that repeat
    rows += [(5000 + i, " ".join([*(f"w{k}" for k in range(140)), f"end{i % 45}"])) for i in range(50)]
    got = similar_classes(make_docs(spark, rows), n, percent, links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(((k, s, m) for k, s, _, m in got), key=str) == brute_links(rows, n, percent)
    assert sorted((r[:3] for r in got), key=str) == brute(rows, n, percent)
    assert max(r[3] for r in got) == 49  # one group is linked all through


def graph_classes(links):
    """Smallest node reachable from each, by walking."""
    near, out = {}, {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for a in sorted(near):
        if a not in out:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = a
                    todo += near[x]
    return out


@pytest.mark.parametrize("shape", ["star", "chain", "stars in a chain", "no links"])
def test_components_with_hot_nodes_and_labels(spark, shape):
    links = {"star": [(500, x) for x in range(1000, 1400)] + [(7, 7)],
             "chain": [(x * 7919 % 1009, (x + 1) * 7919 % 1009) for x in range(300)],
             "stars in a chain": [(10 * c, 100_000 + 500 * c + x) for c in range(5) for x in range(150 * c + 1)]
             + [(10 * c, 10 * c + 10) for c in range(4)] + [(9_000_001 + 2 * x, 9_000_002 + 2 * x) for x in range(50)],
             "no links": []}[shape]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in connected(frame).collect()} == graph_classes(links)


def test_hot_keys_are_few(spark):
    rows = spark.range(10_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id")
    assert hot_keys(rows, "k") == [-1]
    assert hot_keys(rows.where("false"), "k") == []
    assert len(hot_keys(rows.selectExpr("id % 63 AS k"), "k")) == 63
    pairs = rows.select("k").distinct().selectExpr("k", "k * 2 AS v")
    found = looked_up(rows, "k", pairs, [-1], "id")
    assert found.count() == 10_000 and found.where("found = k * 2").count() == 10_000


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, similar_classes(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_enough_tokens(percent):
    r = np.random.default_rng(5)
    for size in [5, 9, 10, 11, 19, 20, 21, 40, 77, 150, 400]:
        for _ in range(60):
            a = r.integers(0, 2**63, size, dtype=np.uint64)
            drop, add = int(r.integers(0, size // 4 + 1)), int(r.integers(0, size // 4 + 1))
            b = np.concatenate([a[drop:], r.integers(0, 2**63, add, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same) and not np.array_equal(a, b):
                bands = Bands(percent)
                (x, need_x), (y, need_y) = bands.tokens(a), bands.tokens(b)
                common = np.intersect1d(x, y)
                shared = [int((common & np.uint64(1) == side).sum()) for side in (0, 1)]
                assert any(s >= m for s, m in zip(shared, need_x)) and any(s >= m for s, m in zip(shared, need_y))


def test_closed_groups_and_classes():
    s = shingle_set(" ".join(f"w{i}" for i in range(100)), 3)
    other = shingle_set(" ".join(f"v{i}" for i in range(100)), 3)
    near = np.concatenate([s[:-2], other[:2]])
    frame = lambda rows: pd.DataFrame(rows, columns=["node", "label", "shingles"])
    members = frame([(1, 1, s), (2, 2, other), (3, 1, near)])
    links = verify_group(members, frame([(4, 4, np.sort(near))]), 90)
    assert len(links) == 1 and links["a"].iloc[0] == 4 and links["b"].iloc[0] in (1, 3)
    assert not len(verify_group(members, frame([(5, 5, np.concatenate([s[:40], other[:40]]))]), 90))


def test_empty_table(spark):
    assert similar_classes(make_docs(spark, []), 3, 90).count() == 0


def test_word_hashes_know_words_by_their_bytes(monkeypatch):
    """Words split as the contract says, equal hashes for equal words only, whatever piece or length."""
    rng = random.Random(5)
    texts = ["", " \t ", "One one ONE", "é É\x85\xa0a", "a\x1cb a\x0bb", "y" * 256 + " " + "y" * 257, "ab ba aab aba baa",
             "z" * 300 + "   " + "z" * 300 + "\n", "q" * 255 + " " * 300 + "q" * 255, "\ud800 a"]
    texts += ["".join(rng.choice("abA \t\n\r\x0c") for _ in range(rng.randrange(900))) for _ in range(300)]
    seen, words = {}, {}
    for piece in (1 << 20, 300):
        monkeypatch.setattr(ngram_join, "PIECE_BYTES", piece)
        for t in texts:
            lower = bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode("utf-8", "replace"))
            parts, hashes = lower.split(), word_hashes(t).tolist()
            assert len(parts) == len(hashes)
            for w, h in zip(parts, hashes):
                assert seen.setdefault(w, h) == h and words.setdefault(h, w) == w
