"""Cases that small fixtures do not reach: long keys, payload columns, unknown ids, unequal files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions import columns as C
from turnlens.operators import linearize as L
from turnlens.operators import ser as S
from turnlens.operators import textmetrics as TM
from turnlens.operators import tokens as TK
from turnlens.sources import files
from turnlens.sources import fixtures as fx


@pytest.mark.parametrize("parts", [3, 16])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_index_is_dense_with_payload_columns(spark, parts, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 300_000
        df = spark.range(n).select(F.concat(F.lit("text of row "), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))
                                   .alias("text"), "id").repartition(7, F.xxhash64("id"))
        for order in ([F.col("id")], [F.xxhash64("id"), F.col("id")]):
            out = TK.index_rows(df, order, "i")
            r = out.agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i")).first()
            assert tuple(r) == (n, n, 0, n - 1)
            if len(order) == 1:
                assert out.where("i <> id").isEmpty()
        b = TK.batches(df, "id", 16).groupBy("batch_id").count()
        assert b.count() == n // 16 and b.where("count <> 16").isEmpty()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_encode_with_a_key_named_id(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    voc = TK.vocab(df, "text")
    e = TK.encode_ids(df, voc, "id", "text")
    assert {r["text"] for r in TK.decode_ids(e.drop("text"), voc, "id", "input_ids").collect()} == {"a b", "b c"}


def test_pad_batch_pads_each_column(spark):
    df = spark.createDataFrame([(0, [1], [1, 2, 3]), (0, [1, 2], [1])], "batch_id int, a array<int>, b array<int>")
    got = sorted((r["a"], r["b"]) for r in TK.pad_batch(df, {"a": 0, "b": 9}, "longest").collect())
    assert got == [([1, 0], [1, 2, 3]), ([1, 2], [1, 9, 9])]


def test_dialogue_keys_are_never_cut(spark):
    df = spark.createDataFrame([(5,), (12345,), (123456,)], "k long")
    assert [r[0] for r in df.select(fx.dialog_key("k")).collect()] == ["1_00005", "1_12345", "1_123456"]


def test_act_names_come_from_a_table_and_unknown_ids_raise(spark):
    turns = spark.createDataFrame([([(0, "s", ["x"]), (12, "s", ["y"])],)], "acts array<struct<act:int,slot:string,values:array<string>>>")
    names = spark.createDataFrame([(0, "INFORM"), (12, "OWN_ACT")], "act int, act_name string")
    row = C.decode_with_table(turns, names, "acts").first()
    assert [a["act"] for a in row["acts"]] == ["INFORM", "OWN_ACT"]
    with pytest.raises(Exception, match="no name for act id 12"):
        turns.select(C.decode_acts("acts")).collect()


def test_meteor_stages_are_arguments(spark):
    df = spark.createDataFrame([(1, "the cats ran home", "the cat ran house")], "row_idx long, ref string, pred string")
    plain = TM.meteor_rows(df).first()["meteor"]
    stemmed = TM.meteor_rows(df, stem=lambda w: w.rstrip("s")).first()["meteor"]
    both = TM.meteor_rows(df, stem=lambda w: w.rstrip("s"), synonyms={"home": "1", "house": "1"}).first()["meteor"]
    assert plain < stemmed < both


def test_ratio_of_long_texts(spark):
    a, b = "abcdefghij " * 30, "abcdefghij " * 30 + "k"
    assert TM.ratio_of_keys(a, b) >= 99


def test_unequal_sides_raise(spark):
    dec = spark.createDataFrame([(1, "a"), (2, "b")], "row_idx long, pred string")
    turns = spark.createDataFrame([(1, "s")], "turn_key long, service string")
    assert S.join_decodes(dec.where("row_idx = 1"), turns).count() == 1
    assert S.join_decodes(dec, turns, strict=False).count() == 1
    with pytest.raises(Exception, match="no partner on the other side for row 2"):
        S.join_decodes(dec, turns).collect()
    with pytest.raises(Exception, match="no partner on the other side for row 1"):
        S.join_decodes(dec.where("row_idx = 2"), turns).collect()


def test_lines_keep_their_order_over_files(spark, tmp_path):
    d = tmp_path / "lines"
    d.mkdir()
    (d / "part-0").write_text("".join(f"a{i}\n" for i in range(3)))
    (d / "part-1").write_text("".join(f"b{i} {'x' * 200}\n" for i in range(3000)))  # a larger file is read first
    lines = files.with_line_index(spark.read.text(str(d))).orderBy("line").collect()
    assert [r["line"] for r in lines] == list(range(3003))
    assert [r["value"].split(" ")[0] for r in lines] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(3000)]


def test_lines_of_one_file_in_many_tasks(spark, tmp_path):
    p = tmp_path / "big"
    p.write_text("".join(f"{i} {'y' * (i % 90)}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spark.read.text(str(p))
        assert df.rdd.getNumPartitions() > 5
        got = files.with_line_index(df)
        assert got.where(F.col("line") != F.split("value", " ")[0].cast("long")).isEmpty() and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_eval_inputs_of_unequal_length_raise(spark, tmp_path):
    (tmp_path / "in").write_text("a\tb\t{}\td\t1\nc\td\t{}\td\t2\n")
    (tmp_path / "pred").write_text("p\n")
    with pytest.raises(Exception, match="no partner on the other side"):
        files.eval_inputs(spark, str(tmp_path / "in"), str(tmp_path / "pred")).collect()


def test_fewshot_ids_count_once(spark):
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "dialog_id string, turn_key long")
    ids = spark.createDataFrame([("d1", "5_shot"), ("d1", "5_shot")], "dialog_id string, size string")
    assert files.fewshot(rows, ids).count() == 1


def test_template_values(spark):
    df = spark.createDataFrame([("I found @ of @.", ["3"]), ("It is @.", ["x", "y"])], "t string, v array<string>")
    assert df.where("size(v) = 2").select(L.template_fill(F.col("t"), F.col("v"))).first()[0] == "It is x."
    with pytest.raises(Exception, match="too few values"):
        df.select(L.template_fill(F.col("t"), F.col("v"))).collect()


def test_empty_values_write_no_value_part(spark):
    df = spark.createDataFrame([([("INFORM", "s", [""]), ("INFORM", "t", ["a", "b"])],)],
                               "acts array<struct<act:string,slot:string,values:array<string>>>")
    text = df.select(L.lin_tsv_naive("acts", F.lit("svc"))).first()[0]
    assert "inform,s |" in text and "inform,t, values = a,b" in text


def test_null_tag_is_not_the_total(spark):
    rows = spark.createDataFrame([("a", True), (None, False)], "tag string, has_slot_error boolean")
    got = [(r["tag"], r["ser"]) for r in S.ser_by_tag(rows).collect()]
    assert sorted(got, key=str) == sorted([("a", 100.0), (None, 0.0), ("overall", 50.0)], key=str)


def test_slots_described_twice(spark):
    s = spark.createDataFrame([("svc", "d", "slot", "one"), ("svc", "d", "slot", "two")],
                              "service string, service_desc string, slot string, slot_desc string")
    assert L.slot_desc_maps(s).first()["slot_desc"] == {"slot": "one"}


def test_any_predicate_for_slot_errors(spark):
    rows = spark.createDataFrame([(1, "a red car", [(0, "colour", ["red"])], ["colour"]), (2, "a car", [(0, "colour", ["red"])], ["colour"]),
                                  (3, "a car", [(0, "kind", ["red"])], ["colour"])],
                                 "row_idx long, pred string, dialog_acts array<struct<act:int,slot:string,values:array<string>>>, perm array<string>")

    @F.pandas_udf("boolean")
    def ends(text, value):
        return text.str.contains("car") & (text.str.len() > 5) & (value.str.len() > 0)

    got = {r["row_idx"]: r["slot_error"] for r in S.slot_error_rows(rows, ends).collect()}
    assert got == {1: False, 2: True, 3: None}


def test_predictor_is_set_up_once_per_task(spark):
    def setup():
        calls = []

        def predict(x):
            calls.append(1)
            return x + f" {len(calls)}"
        return predict

    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_idx long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = [r["pred"].split(" ")[1] for r in TK.batch_predict(df, "row_idx", "text", setup=setup).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == ["1", "1", "2", "2", "3", "3"]


def test_raw_dialogues_with_frames(spark):
    from turnlens.operators.dialogue_rows import task_rows_of_dialogues
    frame = lambda svc, *acts: {"service": svc, "actions": [dict(zip(("act", "slot", "values", "canonical_values"), a)) for a in acts],
                                "service_call": {"method": "Find"}}
    sys = lambda text, *frames: {"speaker": "SYSTEM", "utterance": text, "frames": list(frames)}
    one = sys("It is red\tand\nbig.", frame("A_1", ("INFORM", "colour", ["red"], ["RED"]), ("GOODBYE", "", [], [])))
    two = sys("Both.", frame("A_1", ("CONFIRM", "colour", ["red"], ["RED"])), frame("B_1", ("INFORM", "size", ["big"], ["BIG"])))
    dialogues = spark.createDataFrame([("d1", ["A_1"], [{"speaker": "USER", "utterance": "hi", "frames": []}, one]), ("d2", ["A_1", "B_1"], [two])],
                                      files.SC.RAW_DIALOGUE)
    slots = spark.createDataFrame([(s, f"{s} service", n, f"the {n}", c, "", 0) for s, n, c in [("A_1", "colour", False), ("B_1", "size", True)]],
                                  "service string, service_desc string, slot string, slot_desc string, is_categorical boolean, possible_values string, slot_pos int")
    temps = spark.createDataFrame([("A_1", "INFORM!!colour!!@", "The colour is @."), ("A_1", "GOODBYE", "Bye."),
                                   ("A_1", "CONFIRM!!colour!!@", "Colour @."), ("B_1", "INFORM!!size!!@", "Size @.")],
                                  "service string, act_key string, template string")
    single = dialogues.where("dialogue_id = 'd1'")
    row = task_rows_of_dialogues(single, "naive").first()
    assert (row["input"], row["target"], row["turn_id"]) == ("SYSTEM | service_name=A_1 | inform,colour, values = red | goodbye", "It is red and big.", 0)
    row = task_rows_of_dialogues(single, "schema_guided", slots, delex=True).first()
    assert "inform,name=colour,description=the colour, values = red" in row["input"] and row["target"] == "It is <colour> and big."
    rows = {r["dialog_id"]: r for r in task_rows_of_dialogues(dialogues, "t2g2", templates=temps, canonical=True).collect()}
    assert rows["d1"]["input"] == "SYSTEM | The colour is RED. Bye."
    assert rows["d2"]["input"] == "SYSTEM | Please confirm the following details: Colour RED. Size BIG."
    assert rows["d2"]["metainfo"].count("service_call") == 2
    row = task_rows_of_dialogues(dialogues, "t2g2", slots, temps, delex=True).where("dialog_id = 'd2'").first()
    assert row["input"].endswith("Colour <colour>. Size big.")
    with pytest.raises(Exception, match="several services in a turn of dialogue d2"):
        task_rows_of_dialogues(dialogues, "naive").collect()
    with pytest.raises(Exception, match="has no template with key"):
        task_rows_of_dialogues(dialogues, "t2g2", templates=temps.where("service = 'A_1'")).collect()
    ids = spark.createDataFrame([("d1",)], "dialog_id string")
    assert task_rows_of_dialogues(dialogues, "naive", dialog_ids=ids).count() == 1


def test_unknown_criterion_for_bad_cases(spark):
    from turnlens.operators import analysis as A
    with pytest.raises(ValueError, match="unknown criterion"):
        A.bad_cases(spark.range(1), "colour")


def test_turns_partitioned_by_split(spark, sf_dir, tmp_path):
    t = fx.turns(spark, sf_dir)
    files.write_turns(t, str(tmp_path / "turns"))
    got = files.scan_turns(str(tmp_path / "turns"), ["test"], spark)
    assert got.count() == t.where("split = 'test'").count()
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString() or "split=test" in str(got.inputFiles())


def test_scratch_folder_only_on_a_local_master(monkeypatch):
    from turnlens import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake())


def test_schema_types_are_explicit():
    assert isinstance(files.SC.TURN, T.StructType) and files.SC.TASK_VERSIONS
