"""License scan against every block compared with every template."""

import math
import random
import re

import pytest

from tests.llm.conftest import make_docs
from turnlens.llm.license_scan import PHRASES, SIZES, TEMPLATES, THRESHOLD, Templates, license_blocks, license_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, templates=TEMPLATES, threshold=THRESHOLD, phrases=PHRASES):
    out = []
    for doc, text in rows:
        w = words_of(text)
        places = {(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()}
        hits = []
        for label, t in templates:
            size, own = next(s for s in SIZES if s >= 2 * len(words_of(t))), set(words_of(t))
            for at in range(0, max(len(w) - size // 2, 1), size // 2):
                o = len(own & set(w[at:at + size]))
                if o >= math.ceil(round(threshold * len(own), 9)):
                    hits.append((label, o / len(own)))
        base = {label for _, label in places}
        starts = [i for i, _ in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {h[0] for h in hits})), 1.0 if places else max([h[1] for h in hits], default=0.0), len(hits)))
    return sorted(out, key=str)


def noisy(r, text, share):
    return " ".join(w if r.random() >= share else "".join(r.choice("qxyz") for _ in range(5)) for w in text.split())


def test_as_every_pair(spark, edge_rows):
    r = random.Random(3)
    vocabulary = sorted({w for _, t in TEMPLATES for w in words_of(t)}) + ["lorem", "ipsum", "dolor"] * 40
    rows = list(edge_rows)
    for i in range(60):
        lead = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 700)))
        label, t = r.choice(TEMPLATES)
        rows.append((100 + i, f"{lead}\n{noisy(r, t, r.choice([0, 0.04, 0.08, 0.12, 0.3]))}. {lead[:r.randint(0, 300)]}"))
    rows += [(300, "MIT license mit LICENSE"), (301, "the Apache\tLicense and general public\nlicense"), (302, "mit licenses, submit license"),
             (303, "general public"), (304, TEMPLATES[9][1]), (304, TEMPLATES[9][1]), (305, "Mıt license © été license 2.0")]
    got = [tuple(x) for x in license_report(make_docs(spark, rows)).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == want
    assert len({w[6] for w in want}) > 8 and any(w[2] == 0 and w[6] for w in want) and (300, 4, 2, 0, 2, "mit", "mit", 1.0, 0) in want


def test_small_blocks_thresholds_and_empty(spark):
    templates = [("a", "one two three four five"), ("b", "one six"), ("c", "seven " * 9)]
    rows = [(1, "x " * 13 + "one two three four y five"), (2, "five four three two one"), (3, "one two three four"), (4, "seven"), (5, "six one"),
            (6, None), (7, "")]
    for threshold in (0.5, 0.8, 1.0):
        got = [tuple(x) for x in license_report(make_docs(spark, rows), templates, threshold, {}).collect()]
        assert sorted(got, key=str) == brute(rows, templates, threshold, {})
    blocks = license_blocks(make_docs(spark, rows), templates, 1.0)
    assert {(b["doc_id"], b["label"], b["first_word"]) for b in blocks.collect()} == {(1, "a", 8), (2, "a", 0), (4, "c", 0), (5, "b", 0)}
    assert license_report(make_docs(spark, rows).where("false")).count() == 0


def test_prefixes_and_bad_arguments():
    t = Templates([("a", "one two three four five six seven eight nine ten")], 0.8)
    order = ["ten", "nine", "eight"] + sorted(set(t.words) - {"ten", "nine", "eight"})
    assert [(p[0], p[4]) for p in t.prefixes(order)] == [("ten", 1), ("nine", 2), ("eight", 3)]
    for bad in ([], [("a", "...")], [("a", "w " * 300)]):
        with pytest.raises(ValueError):
            Templates(bad, 0.8)
    with pytest.raises(ValueError):
        Templates(TEMPLATES, 0.0)


def test_no_python_on_the_path(spark):
    plan = license_report(make_docs(spark, [(1, "mit license")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
