"""The secret scan against Python's regular expressions, and the ledger's increments."""

import hashlib
import re

from tests.llm.conftest import make_docs
from turnlens.llm.common import scratch_path
from turnlens.llm.secret_scan import RULES, Ledger, Rule, redacted, scan_documents, secret_report

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


CASES = ["password=abc", "token=token: abcdefgh", "Secret: 'abcdef'", "API_KEY == x", "apikey=\"0123456789abcdef0123456789\"",
         "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16 + "z", "😀 passwd = \t abcdefg", "😀é token  :  'abc.def=='",
         "f" * 24 + "g" + "0" * 23, "0" * 400, "passwordpassword=secret=abcdef, token=abcdefg", "x" * 50_000 + " SECRET=zzzzzz",
         "api-key=abcdefg", "token=" + "a1" * 20 + " token=" + "b2" * 20]


def test_as_brute_force(spark, edge_rows):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(CASES)] + [(100, CASES[0]), (200, CASES[15])]
    got = sorted(map(tuple, secret_report(make_docs(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        found = brute(t or "")
        spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        want.append((i, *[sum(k == kind for _, _, k, _ in found) for kind in ("assign", "access", "hex")],
                     hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert got == sorted(want, key=str)


def test_repeated_rows_are_scanned_once(spark):
    text = "a token=abcdefg b secret=hijklmn c password=opqrstu d " + "f" * 30
    rows = [(1, text), (1, text), (None, text), (2, "token=zzzzzzz and secret=yyyyyyy"), (None, "AKIA" + "B" * 16 + " token=xxxxxxx"),
            (None, "AKIA" + "B" * 16 + " token=xxxxxxx")]
    got = sorted(((r["doc_id"], r["spans"]) for r in secret_report(make_docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i, ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(t))) for i, t in rows), key=str)


def test_ledger_scans_only_what_is_new(spark):
    path = scratch_path(spark, "ledger-test")
    ledger = Ledger(spark, path)
    one = make_docs(spark, [(1, "token=abcdefg"), (2, "clean"), (3, "token=abcdefg")])
    ledger.update(one, RULES)
    assert ledger.scanned(RULES).count() == 2 * len(RULES)
    ledger.update(one, RULES)  # nothing new
    assert ledger.scanned(RULES).count() == 2 * len(RULES)
    two = make_docs(spark, [(4, "token=abcdefg"), (5, "secret=hijklmn")])
    report = {r["doc_id"]: r["spans"] for r in secret_report(two, path).collect()}
    assert report == {4: "assign:0:13", 5: "assign:0:14"}
    assert ledger.scanned(RULES).count() == 3 * len(RULES)
    # a new version of a rule is run over the blobs it is asked for, and old findings no longer count
    newer = [Rule("assign", "clea[n]", version=2), *RULES[1:]]
    report = {r["doc_id"]: r["spans"] for r in secret_report(one, path, newer).collect()}
    assert report == {1: "", 2: "assign:0:5", 3: ""}
    assert ledger.scanned(newer[:1]).count() == 2


def test_redaction(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(90, None), (91, "")]
    out = scan_documents(make_docs(spark, rows))
    for r in out.select("doc_id", "text", redacted(out["text"], out["secret_spans"]).alias("clean")).collect():
        text, want, at = r["text"], "", 0
        if text is None:
            assert r["clean"] is None
            continue
        for a, _, kind, b in brute(text):
            if b > at:
                want += text[at:max(a, at)] + f"[{kind}]"
                at = b
        assert r["clean"] == want + text[at:]


def test_empty_table(spark):
    assert secret_report(make_docs(spark, [])).count() == 0
