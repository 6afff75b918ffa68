"""Array programs over Arrow batches of token lists: n-gram overlap and common subsequences.

Metrics that compare two token lists of the same row need no shuffle: everything they read stands in
that row. These functions work on the flat token arrays of a whole Arrow batch at once (integer codes
instead of strings, sorting instead of hash maps, bit vectors instead of tables), so no Python
statement runs once per row or token, except for long subsequences, which take one big-integer step
per token. Time is linear in the tokens (times 1 / 64 of the shorter list for subsequences). Null
lists and null tokens count as empty lists and as a token of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Lists:
    """Token lists of a batch as flat integer codes; ``start[i]:start[i + 1]`` is row i."""

    def __init__(self, codes: np.ndarray, start: np.ndarray):
        self.codes, self.start = codes, start

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def rows(self) -> np.ndarray:
        """The row of every token."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def take(self, rows: np.ndarray) -> Lists:
        """The lists of the given rows (repeats allowed)."""
        sizes = self.sizes[rows]
        start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], sizes)
        return Lists(self.codes[at], start)


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(*columns: pa.Array) -> list[Lists]:
    """List columns as integer codes, the same for equal tokens of all columns."""
    flat = [c.flatten().cast(pa.large_string()) for c in columns]
    codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, at = [], 0
    for c, f in zip(columns, flat):
        out.append(Lists(codes[at:at + len(f)], np.concatenate([[0], np.cumsum(sizes_of(c))])))
        at += len(f)
    return out


def gram_overlap(a: Lists, b: Lists, max_order: int, weight: np.ndarray | None = None,
                 group: np.ndarray | None = None) -> list[dict[str, np.ndarray]]:
    """For each order 1..max_order and row: ``a, b`` n-grams of each side, ``both`` clipped common n-grams.

    ``group`` numbers the rows' groups (0 up, ascending); the n-grams of a group's rows are then counted
    together and every result has one number per group. ``weight`` gives every token of a (then b) a
    number; an n-gram weighs the mean of its tokens. With it ``a_weight, b_weight, both_weight`` are the same sums of weights.
    """
    n_rows, n_a = len(a), len(a.codes)
    codes = np.concatenate([a.codes, b.codes])
    row = np.concatenate([a.rows, b.rows])
    side = np.arange(len(codes)) >= n_a
    of_row = row if group is None else group[row]
    n_rows = n_rows if group is None else int(group.max(initial=-1)) + 1
    base = int(codes.max(initial=0)) + 1
    summed = None if weight is None else np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
    gram, out = codes, []
    for n in range(1, max_order + 1):
        here = np.arange(max(len(codes) - n + 1, 0))
        if n > 1:  # an n-gram is the (n-1)-gram that starts here and the token that ends it
            end = here + n - 1
            here = here[(row[here] == row[end]) & (side[here] == side[end])]
            pair = gram[here] * base + codes[here + n - 1]
            gram = np.zeros(len(codes), dtype=np.int64)
            gram[here] = np.unique(pair, return_inverse=True)[1]
        kinds = int(gram.max(initial=0)) + 1
        key, at = np.unique(of_row[here] * kinds + gram[here], return_inverse=True)
        in_a = np.bincount(at[~side[here]], minlength=len(key))
        in_b = np.bincount(at[side[here]], minlength=len(key))
        both, of = np.minimum(in_a, in_b), key // kinds
        found = {"a": np.bincount(of_row[here][~side[here]], minlength=n_rows), "b": np.bincount(of_row[here][side[here]], minlength=n_rows),
                 "both": np.bincount(of, both, minlength=n_rows)}
        if summed is not None:
            w = (summed[here + n] - summed[here]) / n
            each = np.zeros(len(key))
            each[at] = w  # equal n-grams of a row weigh the same
            found["a_weight"] = np.bincount(of_row[here][~side[here]], w[~side[here]], minlength=n_rows)
            found["b_weight"] = np.bincount(of_row[here][side[here]], w[side[here]], minlength=n_rows)
            found["both_weight"] = np.bincount(of, both * each, minlength=n_rows)
        out.append(found)
    return out


def common_subsequence(a: Lists, b: Lists) -> np.ndarray:
    """Length of the longest common subsequence of every pair of lists.

    Bit i of a vector stands for token i of the shorter list. For each token of the longer list, with
    ``match`` the places where it stands in the shorter one: ``v = (v + (v & match)) | (v & ~match)``;
    in the end the cleared bits count. Lists of up to 64 tokens go through this row by row of a numpy
    word vector, longer ones as big integers.
    """
    out = np.zeros(len(a), dtype=np.int64)
    swap = a.sizes > b.sizes
    small = np.where(swap, b.sizes, a.sizes)
    large = np.where(swap, a.sizes, b.sizes)
    order = np.argsort(large, kind="stable")  # rows of similar length together
    words = order[(small[order] > 0) & (small[order] <= 64)]
    for lo in range(0, len(words), 2048):
        rows = words[lo:lo + 2048]
        short, long = np.full((len(rows), 64), -1), np.full((len(rows), int(large[rows].max())), -2)
        for s, flip in ((a, False), (b, True)):
            for table, mine in ((short, swap[rows] == flip), (long, swap[rows] != flip)):
                part = s.take(rows[mine])
                place = np.arange(len(part.codes)) - np.repeat(part.start[:-1], part.sizes)
                table[np.flatnonzero(mine)[part.rows], place] = part.codes
        v = np.full(len(rows), ~np.uint64(0))
        for j in range(long.shape[1]):
            match = np.packbits(short == long[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
            v = (v + (v & match)) | (v & ~match)
        out[rows] = np.bitwise_count(~v)
    for i in np.flatnonzero(small > 64):
        s, t = (b, a) if swap[i] else (a, b)
        short, long = s.codes[s.start[i]:s.start[i + 1]].tolist(), t.codes[t.start[i]:t.start[i + 1]].tolist()
        places: dict[int, int] = {}
        for k, token in enumerate(short):
            places[token] = places.get(token, 0) | 1 << k
        full = (1 << len(short)) - 1
        v = full
        for token in long:
            match = places.get(token)
            if match:
                v = (v + (v & match)) & full | v & ~match
        out[i] = len(short) - v.bit_count()
    return out


def parent_scores(pred: Lists, ref: Lists, values: Lists, entry_row: np.ndarray, lambda_weight: float, smoothing: float,
                  max_order: int) -> np.ndarray:
    """PARENT precision, recall and F of every row; ``values`` are the table entries' tokens, ``entry_row`` their rows.

    An n-gram is entailed by the share of its tokens that stand in the row's table. Precision counts
    the prediction's n-grams that the reference holds, and of the others their entailed share; recall
    weighs the reference's n-grams by entailment, and is combined with the table's recall: the mean
    over its entries of the part of their tokens that stand in the prediction in order.
    """
    n = len(pred)
    base = 1 + max(int(x.codes.max(initial=0)) for x in (pred, ref, values))
    held = np.unique(entry_row[values.rows] * base + values.codes)
    weight = np.concatenate([np.isin(x.rows * base + x.codes, held) for x in (pred, ref)]).astype(np.float64)
    precisions, recalls = [], []
    for g in gram_overlap(pred, ref, max_order, weight):
        good = g["a_weight"] + g["both"] - g["both_weight"]
        precisions.append(np.divide(good, g["a"], out=np.zeros(n), where=g["a"] > 0))
        recalls.append(np.divide(g["both_weight"], g["b_weight"], out=np.ones(n), where=g["b_weight"] > 0))

    def mean(parts: list[np.ndarray]) -> np.ndarray:
        """Geometric mean; of the longer n-grams a zero is smoothed, of the single tokens it is final."""
        fixed = [parts[0]] + [np.where(p == 0.0, smoothing, p) for p in parts[1:]]
        logs = sum(np.log(np.where(p > 0.0, p, 1.0)) for p in fixed) / max_order
        return np.where(fixed[0] > 0.0, np.exp(logs), 0.0)

    part = common_subsequence(values, pred.take(entry_row)) / np.maximum(values.sizes, 1)
    table = np.bincount(entry_row, part, minlength=n) / np.maximum(np.bincount(entry_row, minlength=n), 1)
    table = np.where(table == 0.0, smoothing, table)
    precision, recall = mean(precisions), mean(recalls)
    recall = np.where(recall > 0.0, np.exp((1.0 - lambda_weight) * np.log(np.where(recall > 0.0, recall, 1.0))
                                           + lambda_weight * np.log(table)), 0.0)
    return np.column_stack([precision, recall, 2.0 * precision * recall / (precision + recall + 1e-8)])


def letters(column: pa.Array) -> Lists:
    """Code points of every text; a null text is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return Lists(codes, np.concatenate([[0], np.cumsum(sizes)]))


#: Cells of one row of the comparison tables that are worked on at once.
CELLS = 1 << 21


def matching_letters(a: Lists, b: Lists) -> np.ndarray:
    """Letters in matching blocks (Ratcliff and Obershelp) of every pair of texts.

    The longest common substring (the first in a, then in b) is a block; what lies before it in both
    texts, and what lies after it, is matched in the same way. All open pieces of all pairs are searched
    together: their tables of common suffix lengths advance one letter of a at a time.
    """
    total = np.zeros(len(a), dtype=np.int64)
    pieces = np.column_stack([np.arange(len(a)), a.start[:-1], a.start[1:], b.start[:-1], b.start[1:]])
    while len(pieces):
        pieces = pieces[(pieces[:, 2] > pieces[:, 1]) & (pieces[:, 4] > pieces[:, 3])]
        pieces = pieces[np.lexsort((pieces[:, 2] - pieces[:, 1], pieces[:, 4] - pieces[:, 3]))]  # pieces of similar size together
        widths = pieces[:, 4] - pieces[:, 3]
        new, lo = [], 0
        while lo < len(pieces):
            hi = lo + 1
            while hi < len(pieces) and (hi + 1 - lo) * (widths[hi] + 1) <= CELLS and widths[hi] <= 2 * widths[lo] + 8:
                hi += 1
            row, a_lo, a_hi, b_lo, b_hi = pieces[lo:hi].T
            n, width = hi - lo, int(widths[hi - 1])
            at = np.minimum(b_lo[:, None] + np.arange(width), len(b.codes) - 1)
            text = np.where(np.arange(width) < (b_hi - b_lo)[:, None], b.codes[at], -1)
            run = np.zeros((n, width + 1), dtype=np.int32)
            best, best_i, best_j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(int((a_hi - a_lo).max())):
                letter = np.where(a_lo + i < a_hi, a.codes[np.minimum(a_lo + i, len(a.codes) - 1)], -2)
                run[:, 1:] = np.where(text == letter[:, None], run[:, :-1] + 1, 0)
                j = run.argmax(axis=1)
                length = run[np.arange(n), j]
                better = length > best
                best, best_i, best_j = np.where(better, length, best), np.where(better, i, best_i), np.where(better, j, best_j)
            hit = best > 0
            total += np.bincount(row[hit], best[hit], minlength=len(a)).astype(np.int64)
            size, end_a, end_b = best[hit], (a_lo + best_i + 1)[hit], (b_lo + best_j)[hit]
            new.append(np.column_stack([row[hit], a_lo[hit], end_a - size, b_lo[hit], end_b - size]))
            new.append(np.column_stack([row[hit], end_a, a_hi[hit], end_b, b_hi[hit]]))
            lo = hi
        pieces = np.concatenate(new) if new else pieces
    return total


def similarity(a: Lists, b: Lists, least: int = 0) -> np.ndarray:
    """``100 * 2 * matching letters / letters`` of every pair, rounded half-even; pairs that cannot reach ``least`` give 0.

    Letters that both texts hold, in any order, bound the matching ones; only pairs whose bound
    reaches ``least`` are searched for blocks. Equal texts give 100, an empty and another text 0.
    """
    letters_of_both = a.sizes + b.sizes
    whole = np.maximum(letters_of_both, 1)
    bound = np.rint(200 * gram_overlap(a, b, 1)[0]["both"] / whole)
    out = np.where(letters_of_both == 0, 100, 0).astype(np.int64)
    rows = np.flatnonzero((bound >= max(least, 1)) & (letters_of_both > 0))
    out[rows] = np.rint(200 * matching_letters(a.take(rows), b.take(rows)) / whole[rows])
    return np.where(out >= least, out, 0)
