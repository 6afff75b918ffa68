"""METEOR against all alignments, and the stemmer against published pairs."""

import random
from itertools import permutations

import pytest

from turnlens.functions.stem import measure, stem
from turnlens.operators import meteor as M


def all_alignments(h, r, fixed):
    """Every largest matching of equal keys, by trying them all."""
    free_h = [i for i, k in enumerate(h) if i not in fixed and k is not None]
    free_r = [j for j, k in enumerate(r) if j not in set(fixed.values()) and k is not None]
    best, found = -1, []

    def go(at, used, pairs):
        nonlocal best, found
        if at == len(free_h):
            if len(pairs) > best:
                best, found = len(pairs), []
            if len(pairs) == best:
                found.append(fixed | pairs)
            return
        go(at + 1, used, pairs)
        for j in free_r:
            if j not in used and r[j] == h[free_h[at]]:
                go(at + 1, used | {j}, pairs | {free_h[at]: j})

    go(0, frozenset(), {})
    return found


@pytest.mark.parametrize("seed", range(6))
def test_fewest_chunks_of_each_stage(seed):
    r = random.Random(seed)
    for _ in range(60):
        h, t = ([r.choice("aabbcdxyz") for _ in range(r.randint(1, 7))] for _ in range(2))
        second = {"x": "1", "y": "1", "z": "2", "d": "2"}
        got = M.align_stage(h, t, {})
        options = all_alignments(h, t, {})
        assert len(got) == len(options[0]) and M.chunks_of(got) == min(map(M.chunks_of, options))
        h2, t2 = [second.get(w) for w in h], [second.get(w) for w in t]
        more = M.align_stage(h2, t2, got)
        options = all_alignments(h2, t2, got)
        assert got.items() <= more.items() and len(more) == len(options[0]) and M.chunks_of(more) == min(map(M.chunks_of, options))


def test_score_and_stages_in_spark(spark):
    r = random.Random(1)
    vocabulary = "the cats cat running runs run home house is a .".split()
    rows = [(i, *(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9))) for _ in range(2))) for i in range(80)]
    rows += [(100, None, "a"), (101, "", ""), (102, "The cat", "the CAT")]
    df = spark.createDataFrame(rows, "row_idx long, ref string, pred string")
    groups = {"home": "h", "house": "h", "a": "x", "is": "x"}
    table = spark.createDataFrame([*groups.items(), ("a", "y"), ("House", "z")], "word string, group string")
    for kw, own in (({}, {}), ({"stem": True}, {"stem": stem}), ({"stem": True, "synonyms": table}, {"stem": stem, "synonyms": groups})):
        got = {x["row_idx"]: x["meteor"] for x in M.meteor_rows(df, **kw).collect()}
        assert got == pytest.approx({i: M.meteor_one(a, b, **own) for i, a, b in rows})
    assert got[100] == got[101] == 0.0 and got[102] == pytest.approx(1 - 0.5 * 0.5 ** 3)


def test_many_repeats_end(spark):
    text = "the of the of the " * 20
    assert 0.9 < M.meteor_one(text, text) <= 1.0
    assert M.chunks_of({0: 0, 1: 1, 3: 2, 4: 4}) == 3
    orders = {M.meteor_one("a b c", " ".join(p)) for p in permutations("abc")}
    assert max(orders) == M.meteor_one("a b c", "a b c")


def test_stemmer():
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing
        conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file
        happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper
        feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic
        formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer
        adjustable adjust defensible defens replacement replac adjustment adjust dependent depend adoption adopt communism commun
        activate activ effective effect probate probat rate rate cease ceas controll control roll roll is is""".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert stem(word) == want, word
    assert [measure(w) for w in ("tr", "trouble"[:-1], "oaten")] == [0, 1, 2] and stem("naïve") == "naïve"
