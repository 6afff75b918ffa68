"""Token arrays (T1-T10): vocabulary, encode / decode, causal-LM rows, padding, batches, scoring.

Subword tokenizers are per-row codecs outside Spark; here a vocabulary table
does the encoding with explode -> join -> ordered re-collect.  The join is split
by frequency: the ``HOT`` most frequent tokens (the smallest ids) are a broadcast
table of that size, and the occurrences they decide take a key of their own in
the shuffle join of the rest, so no token, however frequent, is one task's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import _col, seeded_hash, ws_tokens
from turnlens.schemas import END_OF_TEXT, IGNORE_LABEL
from turnlens.session import checkpoint_dir

PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
SPECIAL = {PAD_ID: "<pad>", EOS_ID: "</s>", UNK_ID: "<unk>"}
N_SPECIAL = len(SPECIAL)
#: Most frequent tokens, whose ids are broadcast.
HOT = 1000


def index_rows(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Consecutive 0-based index in a total order, without a partition-less window.

    A distributed sort range-partitions the rows; each row gets its position
    inside its partition (``monotonically_increasing_id`` keeps the partition
    in the upper bits) plus the number of rows in earlier partitions.  The
    sorted, numbered frame is checkpointed once, and the row counts and the
    rows are both read from it: two sorts of the same input may cut their
    ranges at different keys.  The offset table has one row per partition.
    """
    checkpoint_dir(df.sparkSession)
    m, p, n, off = (f"_{name}_{x}" for x in ("m", "p", "n", "off"))
    s = df.orderBy(*order).withColumn(m, F.monotonically_increasing_id()).checkpoint()
    s = s.withColumn(p, F.shiftright(m, 33))
    w = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy(p).agg(F.count(F.lit(1)).alias(n)).select(p, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(off))
    return s.join(F.broadcast(offsets), p) \
        .withColumn(name, F.col(off) + F.col(m).bitwiseAND((1 << 33) - 1)).drop(m, p, off)


def vocab(texts: DataFrame, col: str = "text", tokenize: Callable[[Column], Column] = ws_tokens) -> DataFrame:
    """``token, count, id`` — ids by descending frequency (ties by token) after the special ids."""
    counts = texts.select(F.explode(tokenize(F.col(col))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"))
    v = index_rows(counts, [F.desc("count"), F.col("token")])
    return v.select("token", "count", (F.col("idx") + N_SPECIAL).alias("id"))


def frequency_join(rows: DataFrame, table: DataFrame, key: str, hot: Column, value: str, salt: Column) -> DataFrame:
    """Left join of ``rows`` to ``table`` (``key, value``) without a hot key.

    The rows of ``table`` where ``hot`` holds (at most ``HOT``) are broadcast. A row they decide goes through
    the shuffle join with a null key and ``salt``, which spreads it and matches nothing.
    """
    first = rows.join(F.broadcast(table.filter(hot).withColumnRenamed(value, "_hot")), key, "left")
    decided = F.col("_hot").isNotNull()
    salted = first.withColumns({"_cold": F.when(~decided, F.col(key)), "_salt": F.when(decided, salt).otherwise(F.lit(0).cast("long"))})
    rest = table.filter(~hot).select(F.col(key).alias("_cold"), F.lit(0).cast("long").alias("_salt"), F.col(value).alias("_rest"))
    return salted.join(rest, ["_cold", "_salt"], "left").withColumn(value, F.coalesce("_hot", "_rest")) \
        .drop("_hot", "_rest", "_cold", "_salt")


def encode_columns(df: DataFrame, voc: DataFrame, key: str, cols: dict[str, str],
                   tokenize: Callable[[Column], Column] = ws_tokens, add_eos: bool = True,
                   max_length: int | None = None, truncation: bool = False) -> DataFrame:
    """T1 for several text columns in one pass: ``cols`` maps a text column to its column of ids.

    All columns' tokens are stacked with a column number, so the vocabulary is
    joined and the rows are put together once.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), tokenize(F.col(c)).alias("toks")) for i, c in enumerate(cols)])
    toks = df.select(F.col(key).alias("_key"), F.explode(sides).alias("s")) \
        .select("_key", "s.side", F.posexplode("s.toks").alias("pos", "token"))
    ids = voc.select("token", F.col("id").cast("int").alias("_vocab_id"))
    j = frequency_join(toks, ids, "token", F.col("_vocab_id") < N_SPECIAL + HOT, "_vocab_id", F.xxhash64("_key", "side", "pos"))
    found = F.struct("side", "pos", F.coalesce("_vocab_id", F.lit(UNK_ID)).alias("id"))
    g = j.groupBy("_key").agg(F.sort_array(F.collect_list(found)).alias("_xs")).withColumnRenamed("_key", key)
    out = df.join(g, key, "left")

    def ids_of(side: int) -> Column:
        ids = F.transform(F.filter("_xs", lambda x: x["side"] == side), lambda x: x["id"])
        ids = F.coalesce(ids, F.array().cast("array<int>"))
        ids = F.concat(ids, F.array(F.lit(EOS_ID))) if add_eos else ids
        return truncate(ids, max_length, EOS_ID if add_eos else None) if truncation and max_length else ids

    return out.withColumns({o: ids_of(i) for i, o in enumerate(cols.values())}).drop("_xs")


def encode_ids(df: DataFrame, voc: DataFrame, key: str, col: str, out: str = "input_ids",
               tokenize: Callable[[Column], Column] = ws_tokens, add_eos: bool = True,
               max_length: int | None = None, truncation: bool = False) -> DataFrame:
    """Text -> token ids (+ ``attention_mask``); unknown tokens -> ``<unk>``.

    explode(pos, token) -> join vocabulary -> ``sort_array(collect_list(struct(pos, id)))``
    per row.  Rows keep their key; a row's group is its own tokens (bounded by text length).
    """
    e = encode_columns(df, voc, key, {col: out}, tokenize, add_eos, max_length, truncation)
    return e.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(out)))


def truncate(ids, max_length: int, keep_last: int | None = None) -> Column:
    """Cut to ``max_length`` (keeping a final end id if given)."""
    c = _col(ids)
    if keep_last is None:
        return F.slice(c, 1, max_length)
    return F.when(F.size(c) > max_length, F.concat(F.slice(c, 1, max_length - 1), F.array(F.lit(keep_last)))).otherwise(c)


def pad_to(ids, pad, length) -> Column:
    """Right-pad to ``length``; longer sequences are left untouched (negative repeat -> [])."""
    c = _col(ids)
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(c, F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), n - F.size(c)))


def pad_batch(df: DataFrame, cols: dict[str, int], mode: str = "max_length", max_length: int = 1024,
              batch_col: str = "batch_id") -> DataFrame:
    """T1 padding: ``max_length`` pads to a constant, ``longest`` pads each column to its longest row in the batch.

    ``cols`` maps column -> pad value.  ``longest`` needs a batch column (T9)
    and groups on it once.
    """
    if mode == "max_length":
        return df.withColumns({c: pad_to(c, p, max_length) for c, p in cols.items()})
    if mode == "longest":
        longest = df.groupBy(batch_col).agg(*[F.max(F.size(c)).alias(f"_longest_{c}") for c in cols])
        j = df.join(longest, batch_col)
        return j.withColumns({c: pad_to(c, p, F.col(f"_longest_{c}")) for c, p in cols.items()}).drop(*[f"_longest_{c}" for c in cols])
    raise ValueError(f"unknown padding {mode}")


def decode_ids(df: DataFrame, voc: DataFrame, key: str, col: str, out: str = "text",
               skip_special: bool = True) -> DataFrame:
    """Ids -> text (special ids skipped), joined by a space."""
    ids = df.select(F.col(key).alias("_key"), F.posexplode(col).alias("_pos", "_vocab_id"))
    if skip_special:
        ids = ids.filter(F.col("_vocab_id") >= N_SPECIAL)
    tokens = voc.select(F.col("id").cast("int").alias("_vocab_id"), F.col("token").alias("_token"))
    j = frequency_join(ids, tokens, "_vocab_id", F.col("_vocab_id") < N_SPECIAL + HOT, "_token", F.xxhash64("_key", "_pos"))
    g = j.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_token", F.lit(SPECIAL[UNK_ID])).alias("t")))).alias("xs"))
    g = g.select(F.col("_key").alias(key), F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias(out))
    return df.join(g, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def strip_pad(ids, pad: int = PAD_ID) -> Column:
    """T4: remove pad ids."""
    return F.filter(_col(ids), lambda x: x != pad)


def causal_lm_rows(df: DataFrame, bos: int, eos: int, pad: int = PAD_ID, padding: str | None = None,
                   pad_length: int = 1024) -> DataFrame:
    """T5: ``input + [bos] + labels + [eos]``; labels masked by -100 over input + bos; three 0/1 masks."""
    inp = strip_pad("input_ids", pad)
    lab = strip_pad("labels", pad)
    n_in = F.col("_n_in")
    ids = F.concat(inp, F.array(F.lit(bos)), lab, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_LABEL), n_in), lab, F.array(F.lit(eos)))
    out = df.withColumn("_n_in", F.size(inp) + 1).withColumns({
        "input_ids": ids,
        "labels": labels,
    })
    out = out.withColumns({
        "attention_mask": F.array_repeat(F.lit(1), F.size("input_ids")),
        "raw_input_mask": F.array_repeat(F.lit(1), n_in),
        "raw_label_mask": F.transform("labels", lambda x: F.when(x == IGNORE_LABEL, 0).otherwise(1)),
    })
    if padding in ("max_length", "longest"):
        out = out.withColumns({
            "input_ids": pad_to("input_ids", pad, pad_length),
            "labels": pad_to("labels", IGNORE_LABEL, pad_length),
            "attention_mask": pad_to("attention_mask", 0, pad_length),
            "raw_input_mask": pad_to("raw_input_mask", 0, pad_length),
            "raw_label_mask": pad_to("raw_label_mask", 0, pad_length),
        })
    return out.drop("_n_in")


def mask_select(values, mask) -> Column:
    """Keep positions where ``mask`` is 1."""
    m = _col(mask)
    return F.filter(_col(values), lambda v, i: m[i] == 1)


def split_generated(text, part: int) -> Column:
    """Part ``part`` of a generated text split on the end-of-text marker."""
    return F.split(_col(text), "\\Q" + END_OF_TEXT + "\\E").getItem(part)


def batches(df: DataFrame, key: str, batch_size: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """``batch_id`` = index // batch_size in key order (train: seeded hash order); last short batch kept."""
    order = [seeded_hash(key, seed), F.col(key)] if shuffle else [F.col(key)]
    return index_rows(df, order, "_i").withColumn("batch_id", F.floor(F.col("_i") / batch_size)).drop("_i")


def feature_select(df: DataFrame, renames: dict[str, str], cols: list[str]) -> DataFrame:
    """P10: rename then keep only the named columns (pruned down to the scan)."""
    for a, b in renames.items():
        df = df.withColumnRenamed(a, b)
    return df.select(*cols)


Predictor = Callable[[pd.Series], pd.Series]


def batch_predict(df: DataFrame, key: str, input_col: str, predictor: Predictor | None = None, out: str = "pred",
                  setup: Callable[[], Predictor] | None = None) -> DataFrame:
    """Score inputs with a pluggable per-batch predictor (Arrow batches via ``mapInPandas``).

    The predictor maps a pandas Series of inputs to a Series of predictions.
    ``setup`` makes it instead, once per task, and may load a model first.
    """
    schema = T.StructType([df.schema[key], T.StructField(input_col, T.StringType()), T.StructField(out, T.StringType())])

    def run(it):
        predict = setup() if setup is not None else predictor
        for b in it:
            yield pd.DataFrame({key: b[key], input_col: b[input_col], out: predict(b[input_col]).astype(object)})

    return df.select(key, input_col).mapInPandas(run, schema)
