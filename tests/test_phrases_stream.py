"""Phrase mining vs counting from the definition, streaming vs batch."""

import pytest
from pyspark.sql import functions as F

from tests import refimpl as R
from turnlens.operators import phrases as PH

ACTS = "array<struct<act:int,slot:string,values:array<string>>>"


def _turns(spark, rows):
    return spark.createDataFrame([(i, "s", t, [{"act": 0, "slot": sl, "values": v} for sl, v in acts])
                                  for i, (t, acts) in enumerate(rows)],
                                 f"turn_key long, service string, target string, dialog_acts {ACTS}")


def test_mining_matches_definition(spark):
    texts = ["a b c a d. b a c", "a x b y c. c a b", "b a b c d e", "a c b d. a b c", "d a b c a"] * 3
    rows = [(t, [("s1", ["zz"])]) for t in texts]
    turns = _turns(spark, rows)

    def by_count(c):
        return c.withColumn("rank", F.col("count").cast("double"))

    got = PH.mine_patterns(turns, "s1", n_grams=3, min_count=2, top_k=2, rank=by_count)
    got = {(r["pattern"], r["count"]) for r in got.collect()}
    assert got == R.gapped_patterns(texts, 3, 2, 2, float)


def test_current_patterns(spark):
    pats = spark.createDataFrame([("a c", 1, 3, 1.0), ("c a", 1, 3, 1.0), ("b", 1, 5, 1.0)],
                                 "pattern string, level int, count long, rank double")
    got = {r.pattern for r in PH.current_patterns(["a", "b", "c"], pats).collect()}
    assert got == {"a c", "b"}


def test_stream_equals_batch(spark, sf_dir):
    import __spark_entry__ as E
    q = E.queries()
    s = {r.domain: r.ser for r in q["stream_ser"](spark, sf_dir).collect()}
    b = {r.domain: r.ser for r in q["ser_by_domain"](spark, sf_dir).collect()}
    assert s == b
    s = {r.domain: r.bleu for r in q["stream_bleu"](spark, sf_dir).collect()}
    b = {r.domain: r.bleu for r in q["bleu_by_domain"](spark, sf_dir).collect()}
    assert s == pytest.approx(b)


def test_partition_count_does_not_change_results(spark, sf_dir):
    import __spark_entry__ as E
    q = E.queries()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    a = sorted(q["bleu_by_domain"](spark, sf_dir).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    b = sorted(q["bleu_by_domain"](spark, sf_dir).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_sum_over_domains_is_overall(spark, sf_dir):
    from turnlens.plans.common import annotated
    rows = annotated(spark, sf_dir)
    per = rows.groupBy("domain").agg(F.sum(F.col("has_slot_error").cast("int")).alias("e")).agg(F.sum("e")).first()[0]
    assert per == rows.filter("has_slot_error").count()


def test_salted_top_k_is_exact(spark):
    import random
    rnd = random.Random(3)
    rows = [("root", f"t{i}", float(rnd.randint(1, 50))) for i in range(3000)] + \
           [("p1", f"u{i}", float(rnd.randint(1, 5))) for i in range(40)]
    c = spark.createDataFrame(rows, "pid string, tok string, rank double")
    got = {(r.pid, r.tok) for r in PH.top_k_per_parent(c, 5, salts=16).collect()}
    want = set()
    for pid in ("root", "p1"):
        xs = sorted([r for r in rows if r[0] == pid], key=lambda r: (-r[2], r[1]))[:5]
        want |= {(r[0], r[1]) for r in xs}
    assert got == want
