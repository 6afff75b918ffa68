"""Benchmark decontamination by template canonicalisation.

Texts become rows of tokens. Each token has a literal form (lower case, no punctuation around it) and
a template form: numbers, units after a number and names (capitalised inside a sentence) become typed
placeholders. Windows of ``WINDOW`` tokens are hashed in both forms, so a question is found as it
stands, in another case, or with other numbers and names. A template needs ``LITERALS`` tokens that are
no placeholders: a window with fewer is extended to the right and to the left until it holds them, and
meets a window that agrees with it on either side. Texts with fewer such tokens meet literally only.

The windows of the benchmark are hash-joined with those of the documents. Before the join, windows
that hit no benchmark window are dropped by a bitmap of fixed size; it only saves shuffling and never
decides. Phrases that many items share would meet all of them in every document that holds the phrase, so
candidates are found first: a contaminated document meets enough of an item's windows that it cannot miss
all but the ones most shared between items (``rare_windows``). Only for these pairs all windows meet. A document is contaminated by an item if the document holds at least ``share`` of the item's
windows, or ``run`` windows in the item's own order. Slots must be consistent: a value of the item has
to be replaced by the same value wherever it occurs. This is asked of all windows that meet, or of
those of one alignment (one text, one distance between the places), so that a text may hold an item
several times with different values. Literal windows that are enough by themselves decide without slots.

Null and empty texts and items have no windows; neither have items with fewer than ``WINDOW`` tokens.
Items without an id take no part.
Repeated documents are reported each under its id, once per item; rows without an id take no part.
Benchmark items that repeat a text are each reported. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.llm.common import bitmap_of, bounded_batches, in_bitmap, saved, text_or_empty

WINDOW, LITERALS = 5, 3
SHARE, RUN, CONSISTENT = 0.8, 9, 0.8
#: Bits of the bitmap that holds the benchmark's windows (2 MB, whatever the benchmark's size).
BITMAP_BITS = 24
#: Windows of the benchmark that are broadcast, at most (counted); more are joined by a shuffle.
MOST_WINDOWS = 300_000
#: Distinct raw tokens remembered by a worker (speed only), and tokens hashed together.
MEMORY, STEP_TOKENS = 400_000, 500_000

#: Factor of the hashes of extended windows, and its inverse modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)

# Units that become a placeholder after a number.
UNITS = set("""mm cm m km in inch inches ft feet foot yd yard yards mi mile miles g mg kg lb lbs oz ton tons ml l
    liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months
    year years usd eur gbp dollar dollars cent cents euro euros pound pounds percent degrees kmh mph hz khz mhz ghz w kw
    kb mb gb tb""".split())
WORD, NUMBER, UNIT = 0, 1, 2
NUMERIC = re.compile(r"[+-]?[^\W\d_]?\d[\d.,:/%-]*(?:st|nd|rd|th)?|\d+[^\W\d_]{1,4}")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
ENDS = re.compile(r"[.!?:]\W*$")


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


SLOT = {WORD: hash64("<name>"), NUMBER: hash64("<number>"), UNIT: hash64("<unit>")}


class Tokens(dict):
    """Number of each raw token; its properties stand at that place of the arrays."""

    def __init__(self) -> None:
        super().__init__()
        self.lists: list[list] = [[], [], [], []]
        self.arrays: list[np.ndarray] = []

    def __missing__(self, raw: str) -> int:
        word = EDGES.sub("", raw)
        low = word.lower()
        kind = NUMBER if NUMERIC.fullmatch(low) else UNIT if low in UNITS else WORD
        literal, capital, end = self.lists[0], self.lists[2], self.lists[3]
        literal.append(hash64(low) if low else 0)
        self.lists[1].append(kind)
        capital.append(bool(word) and word[0].isupper() and kind == WORD)
        end.append(bool(ENDS.search(raw)))
        n = self[raw] = len(literal) - 1
        return n

    def properties(self) -> list[np.ndarray]:
        done = len(self.arrays[0]) if self.arrays else 0
        if not self.arrays or done != len(self):
            kinds = (np.uint64, np.int8, bool, bool)
            more = [np.array(x[done:], dtype=k) for x, k in zip(self.lists, kinds)]
            self.arrays = [np.concatenate(pair) for pair in zip(self.arrays, more)] if done else more
        return self.arrays


def extended(template: np.ndarray, slot: np.ndarray, owner: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Template hashes of the windows at ``start``, extended to the right and to the left to ``LITERALS`` literals.

    0 where the text ends before. The cost does not depend on how far a window is extended.
    """
    if not len(start):
        return [np.zeros(0, np.uint64)] * 2
    held = np.flatnonzero(~slot)
    out = []
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(template), x, np.uint64)]) for x in (FACTOR, INVERSE))
        sums = np.r_[np.uint64(0), np.cumsum(template * power[:-1])]
        for tag, at in ((2, np.searchsorted(held, start) + LITERALS - 1),
                        (3, np.searchsorted(held, start + WINDOW) - LITERALS)):
            inside = (at >= 0) & (at < len(held))
            edge = held[np.where(inside, at, 0)] if len(held) else start
            inside &= owner[edge] == owner[start]
            first, end = (start, edge + 1) if tag == 2 else (edge, start + WINDOW)
            h = (sums[end] - sums[first]) * back[first]
            h ^= h >> np.uint64(29)
            out.append(np.where(inside, h * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(tag), np.uint64(0)))
    return out


def windows(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, ...]:
    """All windows of the texts: text, place, literal hash, template hash (0: too few literals), tokens, slots, start,
    and of those with too few literals: number, hash extended to the right, to the left.

    ``tokens`` and ``slots`` are one row per window: literal hashes and whether a placeholder stands there.
    """
    if len(tokens) > MEMORY:
        tokens.__init__()
        tokens.clear()
    lists = [[tokens[w] for w in t.split()] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    ids = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    literal_of, kind_of, capital_of, end_of = tokens.properties()
    # punctuation by itself only ends sentences
    first = np.ones(len(ids), dtype=bool)
    if len(ids):
        first[1:] = (owner[1:] != owner[:-1]) | end_of[ids[:-1]]
    real = literal_of[ids] != 0
    ids, owner, first = ids[real], owner[real], first[real]
    n = len(ids) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), literal_of[ids], none.astype(bool), \
            none, none, none.astype(np.uint64), none.astype(np.uint64)
    literal, kind = literal_of[ids], kind_of[ids]
    number = kind == NUMBER
    unit = (kind == UNIT) & np.r_[False, number[:-1] & (owner[1:] == owner[:-1])]
    name = capital_of[ids] & ~first
    slot = number | unit | name
    template = np.where(number, np.uint64(SLOT[NUMBER]), np.where(unit, np.uint64(SLOT[UNIT]),
                        np.where(name, np.uint64(SLOT[WORD]), literal)))
    start = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    place = start - np.searchsorted(owner, owner[start])
    with np.errstate(over="ignore"):
        hashed = []
        for row in (literal, template):
            h = np.zeros(n, dtype=np.uint64)
            for k in range(WINDOW):
                h = h * np.uint64(0x9E3779B97F4A7C15) + (row[k:n + k] ^ np.uint64(k))
            h ^= h >> np.uint64(29)
            hashed.append((h * np.uint64(0xBF58476D1CE4E5B9))[start])
    slots = np.add.reduce([slot[k:n + k].astype(np.int8) for k in range(WINDOW)])[start]
    hashed[1] = np.where((slots > 0) & (WINDOW - slots >= LITERALS), hashed[1] ^ np.uint64(1), np.uint64(0))
    dense = np.flatnonzero(WINDOW - slots < LITERALS)
    return owner[start], place, hashed[0], hashed[1], literal, slot, start, dense, \
        *extended(template, slot, owner, start[dense])


def window_batch(tokens: Tokens, keys: pa.Array, texts: list[str], bitmap: np.ndarray | None) -> pa.RecordBatch:
    """``key, row, place, n_windows, hash, words, slots`` of the windows (those the bitmap holds) in all forms.

    ``row`` tells the texts of one key apart. An extended window has the place, words and slots it had before.
    """
    found = windows(tokens, texts)
    owner, place, literal, template = found[:4]
    total = np.bincount(owner, minlength=len(texts))
    parts, hashes = [], []
    for h, of in ((literal, None), (template, None), (found[8], found[7]), (found[9], found[7])):
        keep = h != 0
        if bitmap is not None:
            keep &= in_bitmap(bitmap, BITMAP_BITS, h)
        keep = np.flatnonzero(keep)
        parts.append(keep if of is None else of[keep])
        hashes.append(h[keep])
    at = np.concatenate(parts)
    hashes = np.concatenate(hashes).view(np.int64)
    if len(at):
        span = found[6][at][:, None] + np.arange(WINDOW)
        words, slots = found[4][span].view(np.int64).ravel(), found[5][span].ravel()
        slots[:len(parts[0]) * WINDOW] = False  # literal windows have no slots
    else:
        words, slots = np.zeros(0, np.int64), np.zeros(0, bool)
    ends = pa.array(np.arange(0, len(at) * WINDOW + 1, WINDOW), pa.int32())
    row = np.array([hash64(t) for t in texts], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(owner[at])), pa.array(row[owner[at]], pa.int64()), pa.array(place[at], pa.int32()),
         pa.array(total[owner[at]], pa.int32()),
         pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(words, pa.int64())),
         pa.ListArray.from_arrays(ends, pa.array(slots, pa.bool_()))],
        names=["id", "row", "place", "n_windows", "hash", "words", "slots"])


_TOKENS = Tokens()


def window_rows(df: DataFrame, id_col: str, text_col: str, bitmap: bytes | None = None) -> DataFrame:
    """Windows of every row in all forms; with ``bitmap`` only those it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)
        for b in batches:
            texts, first, size = b.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 4 * STEP_TOKENS or i == len(texts) - 1:
                    yield window_batch(_TOKENS, b.column(0).slice(first, i + 1 - first), texts[first:i + 1], bits)
                    first, size = i + 1, 0

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, row bigint, place int, n_windows int, hash bigint, words array<bigint>, "
                         "slots array<boolean>")


PAIR = ["id", "item"]
#: One occurrence of an item in one text.
ALIGNED = [*PAIR, "n_windows", "row", "shift"]


def sizes(met: DataFrame) -> DataFrame:
    """``id, item, share, in_order`` of the windows that meet."""
    held = met.groupBy(*PAIR, "n_windows", "place", "shift").agg(F.lit(1).alias("one"))
    shares = held.groupBy(*PAIR, "n_windows").agg((F.count_distinct("place") / F.col("n_windows")).alias("share"))
    ordered = held.groupBy(*PAIR, "shift").agg(F.count("*").alias("n")).groupBy(*PAIR) \
        .agg(F.max("n").alias("in_order"))
    return shares.groupBy(*PAIR).agg(F.max("share").alias("share")).join(ordered, PAIR)


def consistencies(met: DataFrame, by: list[str]) -> DataFrame:
    """``by, consistency`` of the slots that meet; groups without slots are left out."""
    return met.select(*by, F.explode(F.arrays_zip("slots", "item_words", "words")).alias("s")).where("s.slots") \
        .groupBy(*by, F.col("s.item_words").alias("value"), F.col("s.words").alias("other")).count() \
        .groupBy(*by, "value").agg(F.max("count").alias("same"), F.sum("count").alias("all")) \
        .groupBy(*by).agg((F.sum("same") / F.sum("all")).alias("consistency"))


def rare_windows(items: DataFrame, share: float, run: int) -> DataFrame:
    """``hash, item``: windows of each item of which a contaminated document meets at least one.

    It meets at least ``k`` of the item's ``n`` places, ``k`` the smaller of ``share * n`` and ``run``, so it meets one
    of any ``n - k + 1``. Those whose windows the fewest items share are taken. Of an id with texts of
    several lengths all are.
    """
    holders = items.groupBy("hash").agg(F.count_distinct("id").alias("holders"))
    places = items.join(holders, "hash").groupBy("id", "n_windows", "place").agg(F.max("holders").alias("holders"))
    texts = items.groupBy("id").agg(F.count_distinct("n_windows").alias("texts"))
    least = F.least(F.ceil(F.col("n_windows") * share - 1e-9), F.lit(run))
    order = Window.partitionBy("id", "n_windows").orderBy("holders", "place")
    taken = places.withColumn("nth", F.row_number().over(order)).join(texts, "id") \
        .where((F.col("texts") > 1) | (F.col("nth") <= F.col("n_windows") - least + 1)).select("id", "n_windows", "place")
    return items.join(taken, ["id", "n_windows", "place"]).select("hash", F.col("id").alias("item")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE,
                 run: int = RUN) -> DataFrame:
    """``id_col, item_id, share, in_order, consistency`` of every contaminated document and its items.

    The figures are those of the windows that need no extension if these are enough, otherwise those of all
    windows that meet; ``consistency`` then is that of all slots if it is enough, otherwise that of the
    alignment that decides (1 if literal windows decide).
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    items = saved(window_rows(benchmark, item_col, item_text_col).drop("row").distinct())
    hits = saved(window_rows(docs, id_col, text_col, bitmap_of(items.select("hash"), BITMAP_BITS)))
    few = items.count() <= MOST_WINDOWS
    rare = rare_windows(items, share, run)
    pairs = hits.select("id", "hash").join(F.broadcast(rare) if few else rare, "hash").select("id", "item").distinct()
    asked = items.withColumnsRenamed({"id": "item", "words": "item_words", "n_windows": "of", "place": "at"}) \
        .select("item", "hash", "of", "at", "item_words", F.col("slots").alias("item_slots"))
    asked = pairs.join(F.broadcast(asked) if few else asked, "item")
    met = saved(hits.join(asked, ["id", "hash"]).select(
        "id", "item", "row", (F.col("place") - F.col("at")).alias("shift"), F.col("at").alias("place"), F.col("of").alias("n_windows"),
        "words", "item_words", F.col("item_slots").alias("slots")))
    enough = (F.col("share") >= share) | (F.col("in_order") >= run)
    pooled = F.coalesce("consistency", F.lit(1.0))

    def together(rows: DataFrame) -> DataFrame:
        return sizes(rows).where(enough).join(consistencies(rows, PAIR), PAIR, "left").withColumn("consistency", pooled)

    plain = F.size(F.filter("slots", lambda x: x)) <= WINDOW - LITERALS
    every = together(met)
    base = together(met.where(plain)).where(F.col("consistency") >= CONSISTENT) \
        .select(*PAIR, F.struct("share", "in_order", "consistency").alias("base"))
    exact = sizes(met.where(~F.array_contains("slots", True))).where(enough).select(*PAIR, F.lit(1.0).alias("exact"))
    large = met.groupBy(*ALIGNED).agg(F.count_distinct("place").alias("in_order")) \
        .withColumn("share", F.col("in_order") / F.col("n_windows")).where(enough)
    aligned = large.join(consistencies(met, ALIGNED), ALIGNED, "left").groupBy(*PAIR) \
        .agg(F.max(F.coalesce("consistency", F.lit(1.0))).alias("aligned"))
    decided = F.when(F.col("consistency") >= CONSISTENT, F.col("consistency")) \
        .otherwise(F.greatest("consistency", "exact", "aligned"))
    wide = every.join(exact, PAIR, "left").join(aligned, PAIR, "left").withColumn("consistency", decided) \
        .select(*PAIR, F.struct("share", "in_order", "consistency").alias("wide"))
    return wide.join(base, PAIR, "left").select(*PAIR, F.coalesce("base", "wide").alias("f")).select(*PAIR, "f.*") \
        .where(F.col("consistency") >= CONSISTENT) \
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share", "in_order", "consistency")
