"""Token counts and byte-level BPE against the libraries and by round trip."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import make_docs
from turnlens.llm.byte_bpe import ByteBpe, decode_ids, encode_texts, round_trip
from turnlens.llm.token_counts import WordBpe, token_counts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(WORD))
RANKS = {base64.b64decode(a): int(b)
         for a, b in map(bytes.split, open(public_tokenizers.path(BYTE), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER, CODER = WordBpe(public_tokenizers.path(WORD)), ByteBpe(public_tokenizers.path(BYTE), public_tokenizers.PATTERN)


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_any_text_as_the_libraries(texts):
    assert COUNTER.counts(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in CODER.encode(texts)] == TIK.encode_ordinary_batch(texts)


def test_runs_specials_and_long_pretokens():
    r = random.Random(3)
    pieces = ["a", "aa", "aaa", "lo", "ing", " ", "  ", "\n", "'s", "<|endoftext|>", "<|startoftext|>", "<|", "é", "Σ", "中", "!!", "x" * 80]
    texts = ["".join(r.choice(pieces) for _ in range(50)) for _ in range(300)]
    texts += ["a" * 20_000, "".join(r.choice("abcde") for _ in range(20_000)), "", "*" * 5000]
    assert COUNTER.counts(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [ids(x) for x in CODER.encode(texts)] == TIK.encode_ordinary_batch(texts)
    assert [CODER.decode(x) for x in CODER.encode(texts)] == [t.encode() for t in texts]


def test_table_counts(spark, edge_rows):
    got = sorted(map(tuple, token_counts(make_docs(spark, edge_rows), WORD).collect()), key=str)
    want = []
    for i, t in edge_rows:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_table_round_trip(spark, edge_rows):
    docs = make_docs(spark, edge_rows)
    got = sorted(map(tuple, round_trip(docs, BYTE).collect()), key=str)
    want = []
    for i, t in edge_rows:
        e = TIK.encode_ordinary(t or "")
        want.append((i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = decode_ids(encode_texts(docs, BYTE), BYTE).collect()
    assert sorted((bytes(r["decoded"]).decode() for r in back)) == sorted(t or "" for _, t in edge_rows)


def test_empty_tables(spark):
    docs = make_docs(spark, [])
    assert token_counts(docs, WORD).count() == 0
    assert round_trip(docs, BYTE).count() == 0


def test_code_points_of_later_unicode_tables():
    late = ["\U0003d000", "՘", "\U00011de0", "\U0003fc3f", "Ᲊ", "꟔", "\U00010d50", "\U00016ea0"]
    texts = [a + b + c for a in ("", "·", "a", "1", " ", "<|endoftext|>") for b in late for c in ("", "·", "a", "1", b)]
    assert COUNTER.counts(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
