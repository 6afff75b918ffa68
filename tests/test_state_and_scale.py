"""Saved metric state, replayed streams, joins without a hot key, schemas of several splits, active patterns, the predictor."""

import random

import pytest
from pyspark.sql import functions as F

from tests import refimpl as R
from turnlens.functions.columns import decode_acts
from turnlens.operators import analysis as A
from turnlens.operators import linearize as L
from turnlens.operators import metric_state as MS
from turnlens.operators import phrases as PH
from turnlens.operators import ser as S
from turnlens.operators import template_predictor as TP
from turnlens.operators import tokens as TK
from turnlens.sources import fixtures as fx
from turnlens.streaming.metrics_stream import run_stream_once



def table(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_any_split_into_batches_gives_the_one_pass_value(spark, sf_dir, tmp_path):
    rows, perm = fx.decodes(spark, sf_dir, with_acts=True).select("row_idx", "ref", "pred", "service", "dialog_acts"), \
        S.permissible_slots(fx.schema_slots(spark, sf_dir))
    whole = MS.from_sums(MS.grouped_sums(MS.row_statistics(rows, perm), ["domain"]), ["domain"])
    overall = MS.from_sums(MS.grouped_sums(MS.row_statistics(rows, perm)))
    for n in (1, 3):
        state = MS.MetricState(spark, str(tmp_path / f"s{n}"))
        assert state.compute(["domain"]).count() == 0
        for i in range(n):
            state.add_batch(rows.where(F.pmod("row_idx", F.lit(n)) == i), perm, f"b{i}")
        state.add_batch(rows.where(F.pmod("row_idx", F.lit(n)) == 0), perm, "b0")  # repeated: replaces itself
        assert table(state.compute(["domain"])) == table(whole) and table(state.compute()) == table(overall)
    empty = state.add_batch(rows.where("false"), perm)
    assert len(empty) == 32 and table(state.compute()) == table(overall)
    with pytest.raises(ValueError, match="batch name"):
        state.add_batch(rows, perm, "a/b")


def test_replayed_files_count_once(spark, sf_dir, tmp_path):
    rows, perm = fx.decodes(spark, sf_dir, with_acts=True).select("row_idx", "ref", "pred", "service", "dialog_acts"), \
        S.permissible_slots(fx.schema_slots(spark, sf_dir))
    src, work = str(tmp_path / "in"), str(tmp_path / "work")
    half = rows.where("row_idx % 2 = 0")
    for part in (half, rows, half):
        part.coalesce(1).write.mode("append").parquet(src)
    whole = table(MS.from_sums(MS.grouped_sums(MS.row_statistics(rows, perm), ["domain"]), ["domain"]))
    state = run_stream_once(spark, src, perm, work, max_files_per_trigger=1)
    assert table(state.compute(["domain"])) == whole
    rows.coalesce(1).write.mode("append").parquet(src)  # delivered again after the stream stopped
    assert table(run_stream_once(spark, src, perm, work).compute(["domain"])) == whole


def test_hot_tokens_are_spread(spark, monkeypatch):
    monkeypatch.setattr(TK, "HOT", 2)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the"] * 9 + ["a"] * 5 + ["cat", "dog", "ran"]) for _ in range(40)) + (" odd" if i == 7 else "")) for i in range(200)]
    df = spark.createDataFrame(rows + [(200, ""), (201, None)], "k long, text string")
    voc = TK.vocab(df.where("k <> 7"), "text")
    ids = {x["token"]: x["id"] for x in voc.collect()}
    enc = TK.encode_ids(df, voc, "k", "text")
    got = {x["k"]: x["input_ids"] for x in enc.select("k", "input_ids").collect()}
    assert all(got[k] == [ids.get(t, TK.UNK_ID) for t in (text or "").split()] + [TK.EOS_ID] for k, text in rows)
    back = {x["k"]: x["text"] for x in TK.decode_ids(enc.drop("text"), voc, "k", "input_ids", "text").select("k", "text").collect()}
    assert all(back[k] == text.replace(" odd", "") for k, text in rows) and back[200] == ""
    # the shuffle of the join: the rows of the most frequent token lie in all partitions
    one = spark.range(4000).select(F.lit("the").alias("token"), F.col("id").alias("n"))
    j = TK.frequency_join(one, voc.select("token", F.col("id").alias("v")), "token", F.col("v") < 5, "v", F.xxhash64("n"))
    assert j.where(F.col("v") == ids["the"]).count() == 4000
    keys = one.select(F.pmod(F.hash(F.lit(None).cast("string"), F.xxhash64("n")), F.lit(8)).alias("p")).groupBy("p").count().collect()
    assert len(keys) == 8 and max(x["count"] for x in keys) < 2 * 4000 / 8


def test_last_schema_wins_whole(spark):
    rows = [("s_1", "old", "a", "A old", False, "", 0, 0), ("s_1", "old", "b", "B old", False, "x,y", 1, 0),
            ("s_1", "new", "a", "A new", False, "", 0, 1), ("s_1", "new", "c", "C first", False, "", 1, 1), ("s_1", "new", "c", "C last", False, "", 2, 1),
            ("t_1", "only", "a", "T", False, "", 0, 0)]
    slots = spark.createDataFrame(rows, "service string, service_desc string, slot string, slot_desc string, is_categorical boolean, "
                                        "possible_values string, slot_pos int, schema_order int")
    got = {r["service"]: (r["service_desc"], r["slot_desc"]) for r in L.slot_desc_maps(slots).collect()}
    assert got == {"s_1": ("new", {"a": "A new", "c": "C last"}), "t_1": ("only", {"a": "T"})}
    texts = {r["service"]: r["slot_str"] for r in L.slot_strings(slots).collect()}
    assert texts["s_1"] == {"a": "name=a,description=A new", "c": "name=c,description=C last"}
    tmpl = spark.createDataFrame([("s", "K", "one", 0), ("s", "K", "an other", 1)], "service string, act_key string, template string, line int")
    assert L.template_maps(tmpl).first()["tmpl"] == {"K": "an other"} and L.template_maps(tmpl.drop("line")).first()["tmpl"] == {"K": "one"}


def test_own_row_function(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert L.linearize_by_name(df, lambda t: F.upper("a")).first()["_linearized"] == "X"
    with pytest.raises(ValueError):
        L.linearize_by_name(df, "nobody")


@pytest.mark.parametrize("most", [100_000, 0])
def test_active_patterns(spark, monkeypatch, most):
    monkeypatch.setattr(PH, "MOST_PATTERNS", most)
    r = random.Random(5)
    rows = [(i, [r.choice("abcd") for _ in range(r.randint(0, 6))]) for i in range(60)] + [(60, [])]
    pats = [("a", 1), ("b", 1), ("a b", 2), ("b a", 2), ("a b a", 3), ("b a d", 3)]
    patterns = spark.createDataFrame([("", 0, 0)] + [(p, n, 7) for p, n in pats], "pattern string, level int, count long")
    sents = spark.createDataFrame(rows, "k long, toks array<string>")
    got = sorted((x["k"], x["pattern"]) for x in PH.active_patterns(sents, patterns).collect())
    assert got == sorted((k, p) for k, toks in rows for p, _ in pats if R.first_position(toks, p.split(" ")) is not None)
    assert PH.active_patterns(sents, patterns.where("level = 0")).count() == 0


def test_template_predictor_is_the_linearizer(spark, sf_dir):
    turns = fx.turns(spark, sf_dir, splits=["test"]).withColumn("dialog_acts", decode_acts("dialog_acts"))
    t = turns.join(L.template_maps(fx.templates(spark, sf_dir)), "service", "left")
    want = {r[0]: r[1] for r in t.select("turn_key", L.lin_template("dialog_acts", "service", "tmpl", F.lit(fx.FRAME_INTENT))).collect()}
    setup = TP.template_predictor(fx.templates(spark, sf_dir), fx.FRAME_INTENT)
    got = TK.batch_predict(turns.select("turn_key", TP.template_input().alias("i")), "turn_key", "i", setup=setup)
    assert {r["turn_key"]: r["pred"] for r in got.collect()} == want
    assert TP.filled("a @ b @.", ["@", "x", "more"]) == "a @ b x." and TP.render(None, {}, None) is None
    for act, message in (({"act": "NOTIFY_SUCCESS"}, "no intent"), ({"act": "INFORM", "slot": "s", "values": ["True", "x"]}, "more than one")):
        with pytest.raises(ValueError, match=message):
            TP.key_of(act, None)
    with pytest.raises(ValueError, match="more than 1 templates"):
        TP.template_predictor(fx.templates(spark, sf_dir), most=1)


def test_sketches_merge_and_stay_in_bounds(spark):
    ents = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
                                      F.concat(F.lit("d"), F.col("id") % 3).alias("domain"), (F.col("id") % 9000).cast("string").alias("value"))
    sk = A.entity_sketches(ents)
    for by in (["split"], ["split", "domain"]):
        exact = {tuple(r[c] for c in by): r["n"] for r in ents.groupBy(*by).agg(F.countDistinct("value").alias("n")).collect()}
        for r in A.merged_sketches(sk, by).collect():
            n = exact[tuple(r[c] for c in by)]
            assert abs(r["estimate"] - n) <= 3 * 1.04 / 2 ** (A.SKETCH_BITS / 2) * n
