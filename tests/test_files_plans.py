"""File sources / sinks and plan-shape checks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from turnlens.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="turnlens-test-")


def test_read_decodes_drops_overlong_lines(spark):
    d = _tmp()
    with open(os.path.join(d, "test_case.txt"), "w") as f:
        f.write("0|a b | c d | INFORM ( x )\n1|p | q | r | extra\n2|it<vstripe>s | y | z\n")
    got = files.read_decodes(spark, d).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == [0, 2]
    assert got[1].ref == "it|s "
    assert files.read_decodes(spark, d, trim=True).orderBy("row_idx").first().pred == "c d"


def test_read_dialogue_json_lists(spark):
    d = _tmp()
    dial = [{"dialogue_id": "1_00001", "services": ["Hotels_1"], "turns": [
        {"speaker": "USER", "utterance": "hi", "frames": []},
        {"speaker": "SYSTEM", "utterance": "hello", "frames": [{"service": "Hotels_1", "actions": [
            {"act": "INFORM", "slot": "city", "values": ["Napa"], "canonical_values": ["Napa"]}],
            "service_call": {"method": "Find"}}]}]}]
    json.dump(dial, open(os.path.join(d, "dialogues_001.json"), "w"))
    json.dump([{"service_name": "Hotels_1", "description": "x", "slots": []}], open(os.path.join(d, "schema.json"), "w"))
    t = files.dialogue_turns(files.read_dialogues(spark, d))
    rows = files.system_turn_rows(t).collect()
    assert [(r.dialog_id, r.pos, r.turn_id, r.utterance) for r in rows] == [("1_00001", 1, 0, "hello")]


def test_templates_check_errors(spark):
    d = _tmp()
    with open(os.path.join(d, "Hotels_1.tsv"), "w") as f:
        f.write("INFORM!!city!!@\tIt is in @.\nINFORM!!city!!@@\tIt is in @.\n")
    t = files.read_templates(spark, d)
    assert {r.service for r in t.collect()} == {"Hotels_1"}
    flags = {r.act_key: r.consistent for r in files.check_templates(t, strict=False).collect()}
    assert flags == {"INFORM!!city!!@": True, "INFORM!!city!!@@": False}
    with pytest.raises(Exception):
        files.check_templates(t, strict=True).collect()


def test_task_tsv_requires_all_splits(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "train"))
    with pytest.raises(FileNotFoundError):
        files.read_task_tsv(spark, d, "t2g2_all.tsv")
    assert files.task_path("/x", "naive", "5_shot", "dev") == "/x/dev/naive_all.tsv"
    with pytest.raises(ValueError):
        files.task_path("/x", "nope", "5_shot", "dev")


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("key", ["ser_by_domain", "bleu_corpus", "lin_template", "lin_schema", "permissible_acts",
                                 "entity_counts", "encode_ids", "dataset_diff", "rouge_n", "unigram_freq"])
def test_sql_keys_stay_on_the_jvm(spark, sf_dir, key):
    plan = E.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not any(n in plan for n in PY_NODES)


@pytest.mark.parametrize("key", ["lin_schema", "lin_template", "permissible_acts"])
def test_small_dimension_joins_are_broadcast(spark, sf_dir, key):
    plan = E.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_split_filter_reaches_the_scan(spark, sf_dir):
    plan = E.queries()["ser_by_domain"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l and "o_orderkey" in l]
    assert scans and all("% 10" in l for l in scans[:1])


def test_turn_json_round_trip(spark, sf_dir):
    df = E.queries()["turn_json"](spark, sf_dir)
    assert df.filter(~F.col("same")).count() == 0
