"""Spelling variants by a frequency-vector trie.

A word is read as a row of counts: of a few wide letter groups, of single letters (and groups of
letters beyond ASCII), and of letter groups among its first letters. The trie arranges words by these
counts, one level after another. One inserted, deleted or replaced code point adds at most one to one
count of each of the three parts and takes at most one from another, so a search goes down the trie
with a budget of one surplus and one deficit for each part and gives up where it is spent. Words at
the leaves it reaches are verified code point by code point.

The top of the trie is walked by a shuffle, the rest in tasks: every word is stored under its first
counts and sent as a query to the nodes its budget reaches there. Two words with different counts
there meet once, in the node of the one whose first different count is larger. Nodes with more than
``MOST_WORDS`` words are split by further levels, so a node's size does not grow with the vocabulary;
what is left large at the last level, and nodes with more than ``MOST_QUERIES`` queries, are searched
block by block. A task goes depth first with all its queries at once and holds one block of each.

Words are runs of letters of the documents (null texts hold none; a null id counts as the empty text in
the hash that deletes letters). Documents of any length are read whole; repeated rows count each for
itself; an empty table gives no rows; extra columns are ignored. Ties between forms go to the word
that is smaller in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bounded_batches, saved, stored, text_or_empty

#: Least code points of a word, least occurrences, and how much more often a form occurs.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs loses a letter, by its hash.
TYPO = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Wide letter groups (all other code points are a group more), single letters, code points of the head.
WIDE = ("aeiou", "bcdfghjklm")
LETTERS = "etaionshrdlcumwfgypbvkjxqz"
OTHERS, HEAD, HEAD_GROUPS = 4, 4, 8
#: Levels of the three parts: wide groups of the word, letters of the word, letter groups of its head.
PARTS = (len(WIDE) + 1, len(LETTERS) + OTHERS, HEAD_GROUPS)
N_LEVELS = sum(PARTS)
STARTS = {sum(PARTS[:i]) for i in range(len(PARTS))}  # levels at which the budget begins anew
#: Levels that route words to nodes: first, more for large nodes, and the last.
FIRST_CUT, CUT_STEP, LAST_CUT = PARTS[0], 2, PARTS[0] + 12
MOST_WORDS, MOST_QUERIES = 30_000, 400_000
#: Words of a trie leaf; pairs of words and queries that are compared at once instead of going deeper.
LEAF, SMALL, AT_ONCE = 16, 4096, 1 << 16
#: Code points of words that are verified as rows of a table; longer ones are verified one by one.
TABLE_LENGTH = 48
#: Bits of a count in a leaf's comparison.
BITS = 4
#: Large nodes whose names are broadcast; more are joined by a shuffle.
MOST_NAMES = 100_000

WIDE_OF = np.full(256, len(WIDE), dtype=np.int64)
for _i, _group in enumerate(WIDE):
    WIDE_OF[[ord(c) for c in _group]] = _i
LETTER_OF = len(LETTERS) + np.arange(256) % OTHERS
LETTER_OF[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, one letter deleted where the hash says so."""
    pattern = f"[a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"  # shorter runs cannot become words
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(
        F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("w"))
    h = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w"))).withColumn("at", (F.col("h") % F.length("w")).cast("int"))
    rest = F.concat(F.substring("w", F.lit(1), F.col("at")), F.substring("w", F.col("at") + 2, F.length("w")))
    return h.select(F.when(F.col("h") % TYPO == 0, rest).otherwise(F.col("w")).alias("word")) \
        .where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def levels(words: list[str]) -> np.ndarray:
    """One row of counts for each word."""
    out = np.zeros((len(words), N_LEVELS), dtype=np.int32)
    if not words:
        return out
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    code = np.where(code < 256, code, 255).astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    np.add.at(out, (row, WIDE_OF[code]), 1)
    np.add.at(out, (row, PARTS[0] + LETTER_OF[code]), 1)
    head = place < HEAD
    np.add.at(out, (row[head], PARTS[0] + PARTS[1] + LETTER_OF[code[head]] % HEAD_GROUPS), 1)
    return out


def letter_table(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word of at most ``TABLE_LENGTH``, filled up with zeros (longer ones: all zero), and lengths."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    width = int(size[size <= TABLE_LENGTH].max(initial=0)) + 1  # each row ends with a zero
    short = [w.ljust(width, "\0") if len(w) <= TABLE_LENGTH else "\0" * width for w in words]
    return np.frombuffer("".join(short).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).astype(np.uint16), size


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def verified(a: np.ndarray, a_table: tuple, i: np.ndarray, b: np.ndarray, b_table: tuple, j: np.ndarray) -> np.ndarray:
    """``one_edit`` of the words ``a[i]`` and ``b[j]``, pair by pair."""
    out = np.zeros(len(i), dtype=bool)
    la, lb = a_table[1][i], b_table[1][j]
    long = (la > TABLE_LENGTH) | (lb > TABLE_LENGTH)
    for p in np.flatnonzero(long):
        out[p] = one_edit(a[i[p]], b[j[p]])
    width = max(a_table[0].shape[1], b_table[0].shape[1])
    a_table, b_table = (np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in (a_table[0], b_table[0]))
    same = np.flatnonzero((la == lb) & ~long)
    x, y = a_table[i[same]], b_table[j[same]]
    out[same] = (x != y).sum(axis=1) == 1
    for shorter, longer, rows in ((0, 1, np.flatnonzero((lb - la == 1) & ~long)), (1, 0, np.flatnonzero((la - lb == 1) & ~long))):
        sides = a_table[i[rows]], b_table[j[rows]]
        s, l = sides[shorter], sides[longer]
        before = (s != l).argmax(axis=1)  # letters that agree up to the inserted one (they differ there at the latest)
        after = s[:, :-1] != l[:, 1:]
        out[rows] = ~(after & (np.arange(width - 1) >= before[:, None])).any(axis=1)
    return out


def walk(counts: np.ndarray, first: int, last: int, surplus: np.ndarray, deficit: np.ndarray,
         started: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Where each query may go between two levels: ``(query, path, surplus spent, deficit spent, started)``.

    The first count that differs must be larger than the query's own: each pair of nodes is tried from one side.
    """
    at = np.arange(len(counts))
    path = np.zeros((len(counts), 0), dtype=np.int32)
    for level in range(first, last):
        if level in STARTS:
            surplus, deficit = np.zeros_like(surplus), np.zeros_like(deficit)
        own = counts[at, level]
        more, less = ~surplus, ~deficit & started & (own > 0)
        path = np.concatenate([np.column_stack([path, own]), np.column_stack([path, own + 1])[more],
                               np.column_stack([path, own - 1])[less]])
        at = np.concatenate([at, at[more], at[less]])
        surplus, deficit, started = (
            np.concatenate([surplus, np.ones(more.sum(), bool), surplus[less]]),
            np.concatenate([deficit, deficit[more], np.ones(less.sum(), bool)]),
            np.concatenate([started, np.ones(more.sum(), bool), started[less]]))
    yield at, path, surplus, deficit, started


NODE = "node string, is_query boolean, surplus boolean, deficit boolean, started boolean, word string, n bigint"


def routed(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Words at the nodes that their counts from ``first`` to ``last`` name, and as queries at all they may reach."""
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = levels(b["word"].tolist())
            start = b["node"].to_numpy(object)
            flags = [b[c].to_numpy(bool) for c in ("surplus", "deficit", "started")]
            query = b["is_query"].to_numpy(bool)
            for at, path, surplus, deficit, started in walk(counts, first, last, *flags):
                stay = query[at] | (path == counts[at, first:last]).all(axis=1)
                at, path, surplus, deficit, started = (x[stay] for x in (at, path, surplus, deficit, started))
                yield pd.DataFrame({
                    "node": pd.Series([s + "." + ".".join(map(str, p)) for s, p in zip(start[at], path.tolist())], dtype=object),
                    "is_query": query[at], "surplus": surplus, "deficit": deficit, "started": started,
                    "word": pd.Series(b["word"].to_numpy(object)[at], dtype=object), "n": b["n"].to_numpy()[at]})

    return rows.mapInPandas(route, NODE)


def signatures(counts: np.ndarray) -> np.ndarray:
    """Letter and head counts as bits: a count of c sets the first c of its ``BITS`` bits (more counts as ``BITS``)."""
    part = np.minimum(counts[:, PARTS[0]:], BITS)
    bits = (part[:, :, None] > np.arange(BITS)).reshape(len(counts), -1)
    whole, head = bits[:, :PARTS[1] * BITS], bits[:, PARTS[1] * BITS:]
    bits = np.concatenate([np.pad(whole, ((0, 0), (0, -whole.shape[1] % 64))), np.pad(head, ((0, 0), (0, -head.shape[1] % 64)))], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def affordable(stored_bits: np.ndarray, query_bits: np.ndarray) -> np.ndarray:
    """``[query, word]``: whether the counts of a leaf's words are within the budget of each part."""
    fine = None
    n = stored_bits.shape[1]
    for columns in (range(n - 1), (n - 1,)):  # the word's letters, its head's
        up = down = 0
        for c in columns:
            w, q = stored_bits[None, :, c], query_bits[:, None, c]
            up = up + np.bitwise_count(w & ~q)
            down = down + np.bitwise_count(q & ~w)
        part = (up <= 1) & (down <= 1)
        fine = part if fine is None else fine & part
    return fine


def search(stored_counts: np.ndarray, query_counts: np.ndarray, first: int, surplus: np.ndarray,
           deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of the trie below a node: ``(query, stored row)`` pairs within the budget.

    A node is a range of the stored rows, which are sorted by their counts; all queries that can still
    pay for it go down together. A leaf's words are compared with all of them by their counts.
    """
    stored_bits, query_bits = signatures(stored_counts), signatures(query_counts)
    stack = [(0, len(stored_counts), first, np.arange(len(query_counts)), surplus, deficit)]
    while stack:
        lo, hi, level, rows, more, less = stack.pop()
        while level < N_LEVELS and hi - lo > LEAF and (hi - lo) * len(rows) > SMALL:
            if level in STARTS:
                more, less = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            column = stored_counts[lo:hi, level]
            own = query_counts[rows, level]
            if column[0] != column[-1]:
                break
            diff = column[0] - own
            fine = (diff == 0) | (diff == 1) & ~more | (diff == -1) & ~less
            rows, more, less = rows[fine], (more | (diff == 1))[fine], (less | (diff == -1))[fine]
            level += 1
        if not len(rows):
            continue
        if level == N_LEVELS or hi - lo <= LEAF or (hi - lo) * len(rows) <= SMALL:
            for a in range(0, len(rows), max(1, AT_ONCE // (hi - lo))):
                part = rows[a:a + max(1, AT_ONCE // (hi - lo))]
                q, w = np.nonzero(affordable(stored_bits[lo:hi], query_bits[part]))
                yield part[q], w + lo
            continue
        edges = np.flatnonzero(np.diff(column)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, hi - lo]):
            diff = column[a] - own
            fine = np.flatnonzero((diff == 0) | (diff == 1) & ~more | (diff == -1) & ~less)
            if len(fine):
                d = diff[fine]
                stack.append((lo + a, lo + b, level + 1, rows[fine], more[fine] | (d == 1), less[fine] | (d == -1)))


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about ``AT_ONCE`` at a time."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def near_words(group: pd.DataFrame, first: int) -> pd.DataFrame:
    """``word, n_near, best, best_n`` of the words of one block that are near one of its queries, or the reverse."""
    found: dict[str, list] = {}

    def add(word: str, near: str, n: int) -> None:
        entry = found.get(word)
        if entry is None:
            found[word] = [1, near, n]
        else:
            entry[0] += 1
            if n > entry[2] or n == entry[2] and near < entry[1]:
                entry[1], entry[2] = near, n

    queries = group[group["is_query"]]
    words = group[~group["is_query"]]
    if len(queries) and len(words):
        names, n = words["word"].to_numpy(object), words["n"].to_numpy()
        counts = levels(names.tolist())
        order = np.lexsort(counts.T[::-1])
        names, n, counts = names[order], n[order], counts[order]
        asked, asked_n = queries["word"].to_numpy(object), queries["n"].to_numpy()
        crossed = queries["started"].to_numpy(bool)
        asked_counts = levels(asked.tolist())
        top = max(int(counts.max(initial=0)), int(asked_counts.max(initial=0)))
        kind = np.int8 if top < 100 else np.int32
        pairs = search(counts.astype(kind), asked_counts.astype(kind), first, queries["surplus"].to_numpy(bool),
                       queries["deficit"].to_numpy(bool))
        table, asked_table = letter_table(names), letter_table(asked)
        for qs, ws in gathered(pairs):
            good = verified(asked, asked_table, qs, names, table, ws)
            for q, w in zip(qs[good].tolist(), ws[good].tolist()):
                add(asked[q], names[w], int(n[w]))
                if crossed[q]:  # of two words at one node each asks for itself
                    add(names[w], asked[q], int(asked_n[q]))
    columns = {"word": list(found), "n_near": [v[0] for v in found.values()], "best": [v[1] for v in found.values()],
               "best_n": [v[2] for v in found.values()]}
    return pd.DataFrame({c: pd.Series(v, dtype="int64" if c.endswith(("near", "_n")) else object) for c, v in columns.items()})


def with_names(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Join by node name; the names are broadcast while there are few (counted)."""
    return rows.join(F.broadcast(names) if names.count() <= MOST_NAMES else names, "node", how)


def near_of(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n``: how many words are near, and the one that occurs most (the smallest of several)."""
    bounded_batches(words.sparkSession, 10_000)
    both = words.select(F.lit("").alias("node"), F.explode(F.array(F.lit(False), F.lit(True))).alias("is_query"),
                        *[F.lit(False).alias(c) for c in ("surplus", "deficit", "started")], "word", "n")
    cut = FIRST_CUT
    rows = stored(routed(both, 0, cut), "trie-top")
    searched = None
    while True:
        sizes = saved(rows.groupBy("node").agg(F.count_if(~F.col("is_query")).alias("w"), F.count_if("is_query").alias("q")))
        large = sizes.where(F.col("w") > MOST_WORDS).select("node")
        deeper = cut < LAST_CUT and not large.isEmpty()
        small = with_names(rows, large, "left_anti") if deeper else rows
        part = in_blocks(small, sizes, cut)
        searched = part if searched is None else searched.unionByName(part)
        if not deeper:
            break
        rows = stored(routed(with_names(rows, large, "left_semi"), cut, cut + CUT_STEP), "trie-deeper")
        cut += CUT_STEP
    best = F.max(F.struct(F.col("best_n"), F.col("backward"), F.col("best"))).alias("m")
    # equal counts: the smaller word wins, as the larger of its complemented UTF-8 bytes closed by a high end mark
    flip = F.concat(F.translate(F.hex(F.encode("best", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return searched.withColumn("backward", flip).groupBy("word").agg(F.sum("n_near").alias("n_near"), best) \
        .select("word", "n_near", F.col("m.best").alias("best"), F.col("m.best_n").alias("best_n"))


def in_blocks(rows: DataFrame, sizes: DataFrame, cut: int) -> DataFrame:
    """Near words of all nodes: every block of a node's words against every block of its queries."""
    several = sizes.where((F.col("w") > MOST_WORDS) | (F.col("q") > MOST_QUERIES)).select(
        "node", F.ceil(F.col("w") / MOST_WORDS).cast("int").alias("wb"), F.ceil(F.col("q") / MOST_QUERIES).cast("int").alias("qb"))
    known = with_names(rows, several, "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("wb", "qb")})
    h = F.xxhash64("word")

    def blocks(mine: Column, count: str) -> Column:
        """The row's own block of its side, or all blocks of the other side."""
        return F.when(mine, F.array(F.pmod(h, F.col(count)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(count) - 1))

    dealt = known.withColumn("w_block", F.explode(blocks(~F.col("is_query"), "wb"))) \
        .withColumn("q_block", F.explode(blocks(F.col("is_query"), "qb"))).drop("wb", "qb")
    return dealt.groupBy("node", "w_block", "q_block").applyInPandas(
        lambda group: near_words(group, cut), "word string, n_near bigint, best string, best_n bigint")


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word of each chain of forms; a form occurs ``RATIO`` times as often, so chains are short."""
    steps = saved(forms.select("word", F.col("form").alias("root")))
    onward = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        new = saved(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")))
        steps = new.select("word", "root")
        if new.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = stored(count_words(docs, id_col, text_col), "words")
    return group_variants(words, ratio)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The same of a table of distinct words and their counts (``word, n``)."""
    found = words.join(near_of(words), "word", "left")
    is_form = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = roots_of(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
