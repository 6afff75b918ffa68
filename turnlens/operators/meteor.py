"""A10: METEOR with stages of matching and the alignment with the fewest chunks.

Words are matched in stages (equal words, equal stems, words of one synonym group); a stage matches
as many of the words left by earlier stages as it can. Words that occur several times can be matched
in several ways; of all matchings of a stage the one with the most neighbouring pairs is taken, that is
with the fewest chunks (Lavie and Agarwal 2007). It is found by going through the prediction once and
keeping, for each set of reference places used so far and each last place, the best number of
neighbouring pairs: the best ``STATES`` of them, which is all of them unless a text repeats many words
many times. Only which words are equal matters for that, so it is done on the texts' pattern (runs of
words that can go one way only drawn together), and a worker keeps the matchings of its last patterns.

Synonyms come as a table ``word, group`` of any size and are joined to the words of the texts; a word in
several groups belongs to the smallest. Null texts score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.stem import stem as porter_stem

#: States kept at a word of the prediction.
STATES = 512
#: States of the first search, which tells what the others must reach.
FIRST_STATES = 8
#: Patterns of a Python worker whose matchings are kept.
PATTERNS = 1 << 14
#: The code of words that match nothing.
GAP = -1
#: Stands for the place of a skipped word; greater than all places.
SKIP = 1 << 60
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
WORD = r"(?U)\w+|[^\w\s]"
_WORD = re.compile(r"\w+|[^\w\s]")


def align_stage(hyp: list, ref: list, fixed: dict[int, int]) -> dict[int, int]:
    """Match the keys of one stage (None: no key); ``fixed`` holds the pairs of earlier stages. Returns all pairs."""
    taken = set(fixed.values())
    places: dict = {}
    for j, key in enumerate(ref):
        if key is not None and j not in taken:
            places.setdefault(key, []).append(j)
    left = Counter(k for i, k in enumerate(hyp) if i not in fixed and k in places)
    if not left:
        return fixed
    sole = fixed | {i: places[k][0] for i, k in enumerate(hyp) if i not in fixed and left[k] == len(places.get(k, ())) == 1}
    partner = {j: i for i, j in sole.items()}
    # Words that can go one way only and stand together in both texts are one word of the pattern, words without a place are gaps.
    code: dict = {}
    h_code, h_start, length = [], [], []
    for i, key in enumerate(hyp):
        if i in sole:
            if sole.get(i - 1, -2) == sole[i] - 1:
                length[-1] += 1
                continue
            h_code.append(code.setdefault((i,), len(code)))
        elif key in left:
            h_code.append(code.setdefault(key, len(code)))
        elif h_code and h_code[-1] == GAP:
            continue
        else:
            h_code.append(GAP)
        h_start.append(i)
        length.append(1)
    r_code, r_start = [], []
    for j, key in enumerate(ref):
        if j in partner:
            if sole.get(partner[j] - 1, -2) == j - 1:
                continue
            r_code.append(code[(partner[j],)])
        elif j not in taken and key in left:
            r_code.append(code[key])
        elif not r_code or r_code[-1] == GAP:
            continue
        else:
            r_code.append(GAP)
        r_start.append(j)
    found = best_pairs(tuple(h_code), tuple(r_code))
    return fixed | {h_start[i] + n: r_start[j] + n for i, j in found for n in range(length[i])}


@lru_cache(maxsize=PATTERNS)
def best_pairs(hyp: tuple[int, ...], ref: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    """The pairs of equal codes with the most neighbours, as many pairs as can be; ``GAP`` matches nothing.

    A first search keeps few states. Its number of neighbouring pairs can be had, so the search proper
    leaves out every state that falls short of it even if the later words find all the neighbours that
    both texts have.
    """
    beside = Counter(pair for pair in zip(ref, ref[1:]) if GAP not in pair)
    later, found = [0] * len(hyp), 0
    for i in range(len(hyp) - 1, 0, -1):
        pair = hyp[i - 1], hyp[i]
        if beside[pair] > 0:
            beside[pair] -= 1
            found += 1
        later[i - 1] = found
    first = _search(hyp, ref, FIRST_STATES, later, 0)
    chain, out = (_search(hyp, ref, STATES, later, first[0]) or first)[1], []
    while chain:
        chain, i, j = chain
        out.append((i, j))
    return tuple(out)


def _search(hyp: tuple[int, ...], ref: tuple[int, ...], most: int, later: list[int], enough: int) -> tuple | None:
    """``neighbouring pairs, pairs as a chain``; at most ``most`` states, only those that can reach ``enough`` neighbours."""
    places: dict[int, list[int]] = {}
    for j, key in enumerate(ref):
        if key != GAP:
            places.setdefault(key, []).append(j)
    left = Counter(hyp)
    open_words = [(i, k) for i, k in enumerate(hyp) if k in places and (left[k] > 1 or len(places[k]) > 1)]
    # a state: the used places as bits above the last place + 2 (0: none); its value: neighbouring pairs, pairs as a chain
    width = (len(ref) + 2).bit_length()
    low = (1 << width) - 1
    states: dict[int, tuple] = {0: (0, None)}
    seen: Counter = Counter()
    cut = False
    for i, key in enumerate(hyp):
        new: dict[int, tuple] = {}
        floor = enough - later[i]
        spots = [(1 << width + j, j + 2) for j in places.get(key, ())]
        mask = sum(bit for bit, _ in spots)
        # how many of the words so far must have been matched for this one to be skipped
        least = 0 if key == GAP else seen[key] - max(0, left[key] - len(spots)) + 1
        for state, value in states.items():
            near, pairs = value
            last = state & low
            used = state ^ last
            for bit, end in spots:
                if not used & bit:
                    n = near + 1 if end == last + 1 else near
                    if n < floor:
                        continue
                    to = used | bit | end
                    old = new.get(to)
                    if old is None or n > old[0]:
                        new[to] = (n, (pairs, i, end - 2))
            if near >= floor and (used & mask).bit_count() >= least:
                old = new.get(used)
                if old is None or near > old[0]:
                    new[used] = value
        seen[key] += 1
        if enough and len(new) > 1:   # the order they would have among all states decides between equals
            cut = cut or _all_states(seen, key, left, places) > most
            new = dict(sorted(new.items(), key=(lambda s: -s[1][0]) if cut else (
                lambda s: _first_path(s[0] >> width, (s[0] & low) - 2, i, open_words, places))))
        if len(new) > most:
            new = dict(sorted(new.items(), key=lambda s: -s[1][0])[:most])
        states = new
    return max(states.values(), key=lambda s: s[0], default=None)


def _all_states(seen: Counter, last: int, left: Counter, places: dict[int, list[int]]) -> int:
    """How many states there are after the words ``seen``, the last of them of key ``last``."""
    out = 1
    for key, n in seen.items():
        if key in places:
            p = len(places[key])
            sets = range(max(0, n - max(0, left[key] - p)), min(n, p) + 1)
            out *= sum(comb(p, a) * ((a + (a < n)) if key == last else 1) for a in sets)
    return out


def _first_path(used: int, last: int, at: int, open_words: list[tuple[int, int]], places: dict[int, list[int]]) -> list[int]:
    """The first way to a state after word ``at``: the places of the words with a choice, lowest first, skips last."""
    rest: dict[int, Iterator[int]] = {}
    out = []
    for i, key in open_words:
        if i >= at:
            if i == at:
                out.append(last if last >= 0 else SKIP)
            break
        if key not in rest:
            rest[key] = iter([j for j in places[key] if used >> j & 1 and j != last])
        out.append(next(rest[key], SKIP))
    return out


def chunks_of(pairs: dict[int, int]) -> int:
    """Runs of pairs that are neighbours in both texts."""
    return sum(1 for i, j in pairs.items() if pairs.get(i - 1, -2) != j - 1)


def meteor_score(hyp_stages: list[list], ref_stages: list[list], alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> float:
    """METEOR of two texts given the keys of their words at each stage."""
    n_hyp, n_ref = len(hyp_stages[0]), len(ref_stages[0])
    pairs: dict[int, int] = {}
    for h, r in zip(hyp_stages, ref_stages):
        pairs = align_stage(h, r, pairs)
    if not pairs:
        return 0.0
    precision, recall = len(pairs) / n_hyp, len(pairs) / n_ref
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return (1 - gamma * (chunks_of(pairs) / len(pairs)) ** beta) * mean


def meteor_one(ref: str, hyp: str, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
               stem: Callable[[str], str] | None = None, synonyms: dict | None = None) -> float:
    """METEOR of one pair of texts."""
    stages = []
    for text in (hyp, ref):
        words = [w.lower() for w in _WORD.findall(text or "")]
        stages.append([words] + ([[stem(w) for w in words]] if stem else [])
                      + ([[synonyms.get(w) for w in words]] if synonyms else []))
    return meteor_score(*stages, alpha, beta, gamma) if all(s[0] for s in stages) else 0.0


def _with_groups(df: DataFrame, key: str, synonyms: DataFrame) -> DataFrame:
    """Synonym groups of the words of both sides (``_hg, _rg``): one join over all words, put together by row."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("words")) for s, c in (("h", "_h"), ("r", "_r"))])
    words = df.select(key, F.explode(sides).alias("s")).select(key, "s.side", F.posexplode("s.words").alias("place", "word"))
    groups = synonyms.select(F.lower("word").alias("word"), F.col("group").cast("string").alias("group")) \
        .groupBy("word").agg(F.min("group").alias("group"))
    found = words.join(groups, "word").groupBy(key).agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("place", "group")))).alias(f"_{s}m") for s in "hr"])
    j = df.join(found, key, "left")
    return j.withColumns({"_hg": F.transform("_h", lambda w, i: F.element_at("_hm", i)),
                          "_rg": F.transform("_r", lambda w, i: F.element_at("_rm", i))}).drop("_hm", "_rm")


def meteor_rows(df: DataFrame, key: str = "row_idx", ref: str = "ref", pred: str = "pred",
                stem: Callable[[str], str] | bool | None = None, synonyms: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Per-row METEOR; the corpus value is the mean.

    ``stem`` is a function or True for the built-in stemmer; ``synonyms`` maps words to groups, as a
    small dict or as a table ``word, group``.
    """
    if isinstance(synonyms, dict):
        synonyms = df.sparkSession.createDataFrame(list(synonyms.items()), "word string, group string") if synonyms else None
    x = df.select(key, *[F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(WORD), F.lit(0)), F.lower).alias(a)
                         for a, c in (("_h", pred), ("_r", ref))])
    with_groups = synonyms is not None
    if with_groups:
        x = _with_groups(x, key, synonyms)
    stemmer = porter_stem if stem is True else stem or None

    def one(h, r, hg, rg) -> float:
        if not len(h) or not len(r):
            return 0.0
        stages = [(list(h), list(r))]
        if stemmer:
            stages.append(([stemmer(w) for w in h], [stemmer(w) for w in r]))
        if with_groups:
            stages.append((list(hg), list(rg)))
        return meteor_score([s[0] for s in stages], [s[1] for s in stages])

    @F.pandas_udf(T.DoubleType())
    def score(h: pd.Series, r: pd.Series, hg: pd.Series, rg: pd.Series) -> pd.Series:
        return pd.Series([one(*v) for v in zip(h, r, hg, rg)], dtype="float64")

    groups = [F.col("_hg"), F.col("_rg")] if with_groups else [F.col("_h"), F.col("_r")]
    return x.select(key, score("_h", "_r", *groups).alias("meteor"))
