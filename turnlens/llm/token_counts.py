"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held in one ragged numpy array of symbols. In every round each
pre-token finds the lowest rank among its adjacent pairs, all its occurrences of that pair are
merged at once, and finished pre-tokens leave the array. The symbols that survive are the tokens.

Null and empty texts count 0 tokens. Whole texts are counted, whatever their length. Repeated
rows are counted each for itself; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bounded_batches, text_or_empty

OVER_LIMIT = 2048
#: Characters tokenised together; bounds the memory of one step.
STEP_CHARS = 1_000_000
#: Distinct pre-tokens remembered by a worker; then the memory starts anew (speed only).
MEMORY = 400_000
NO_RANK = np.int64(1) << 40

# Capitals whose lower case the tokenizer library takes otherwise than str.lower.
LOWER = {"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7dc": "\u019b"}

# Fixed values, by differences of the Unicode tables: code points that ``regex`` takes for letters or
# digits and the tokenizer library for neither, and capitals that only the library lower-cases.
NOT_YET = "".join("-".join(chr(int(c, 16)) for c in run.split("-")) for run in (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F ").split())
LATE_LOWER = {0x1c89: 0x1c8a, **{c: c + 1 for c in (0xa7cc, 0xa7ce, 0xa7d2, 0xa7d4, 0xa7da)},
              **{c: c + 0x20 for c in range(0x10d50, 0x10d66)}, **{c: c + 0x1b for c in range(0x16ea0, 0x16eb9)}}
LATE = re.compile(f"[{NOT_YET}{''.join(map(chr, LATE_LOWER))}]")
LATE_BMP = re.compile("[{}]".format("".join(c for c in map(chr, range(0x80, 0xd800)) if LATE.match(c))))


def late(text: str) -> bool:
    """Whether such code points stand in a text; those above U+FFFF are looked for only where it has any there."""
    return not text.isascii() and (LATE_BMP.search(text) is not None or
                                   len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) and LATE.search(text) is not None)


# The byte alphabet of byte-level vocabularies maps printable Latin-1 bytes to
# themselves and all other bytes, in order, to code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    """Character that stands for each of the 256 bytes."""
    rest = iter(range(256, 512))
    keep = set(PRINTABLE)
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Counts the tokens of a byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.width = np.int64(max(vocab.values()) + 1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, first.astype(np.int64), made
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"][0]
        words = split["pattern"]["Regex"]
        self.words = regex.compile(words)
        for x in ("\\p{L}", "\\p{N}"):
            words = words.replace(f"[{x}]", f"[{x}--[{NOT_YET}]]")
        words = words.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{NOT_YET}]]")
        self.late_words = regex.compile(words, regex.V1)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.seen: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK)

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each non-empty pre-token."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        counts = np.ones(len(words), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        # the rank at i is that of the pair (i, i + 1); a word's last symbol opens no pair
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NO_RANK
            if not live.all():
                done = ~live
                counts[owner[starts[done]]] = lengths[done]
                keep = np.repeat(live, lengths)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                least, lengths = least[live], lengths[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # neighbours that overlap (a a a): take every other one of a run, from the left
            first = np.r_[True, np.diff(hit) > 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            rank[hit] = rank[hit + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            # the right neighbour of a merged pair keeps whether a pair may open there
            last = np.r_[owner[1:] != owner[:-1], True]
            closed = last[hit + 1]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            open_at = at[~closed]
            rank[at[closed]] = NO_RANK
            rank[open_at] = self._rank(symbols[open_at], symbols[open_at + 1])
            before = at[at > 0]
            before = before[owner[before - 1] == owner[before]] - 1
            rank[before] = self._rank(symbols[before], symbols[before + 1])
        return counts

    def normal(self, text: str) -> str:
        """Canonical composition, lower case; white space only separates pre-tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for upper, lower in LOWER.items():
                if upper in text:
                    text = text.replace(upper, lower)
        return text.lower()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, lists, waiting = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and "<|" in text:
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            split = self.words.findall
            if late(text):
                split, parts = self.late_words.findall, [p.translate(LATE_LOWER) for p in parts]
            words = [w for p in parts for w in split(self.normal(p))]
            lists.append((i, words))
            waiting += len(text)
            if waiting >= STEP_CHARS:
                self._add(out, lists)
                lists, waiting = [], 0
        self._add(out, lists)
        return out

    def _add(self, out: list[int], lists: list[tuple[int, list[str]]]) -> None:
        if len(self.seen) > MEMORY:
            self.seen.clear()
        new: set[str] = set()
        for _, words in lists:
            new.update(words)
        fresh = [w for w in new if w not in self.seen]
        if fresh:
            self.seen.update(zip(fresh, self.merge_counts(fresh).tolist()))
        get = self.seen.__getitem__
        for i, words in lists:
            out[i] += sum(map(get, words))


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The counter for a vocabulary file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = OVER_LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row.

    ``vocab`` is the name of a file of the public tokenizers, which every executor has installed.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        bpe = word_bpe(public_tokenizers.path(vocab))
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(bpe.counts(b.column(2).to_pylist()), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"),
                       text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint") \
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
