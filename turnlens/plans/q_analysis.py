"""Analysis keys: corpus statistics, unseen entities, dataset diff, ordering / sampling, few-shot."""

from pyspark.sql import functions as F

from turnlens.operators import analysis as A
from turnlens.operators import ser as S
from turnlens.plans.common import annotated, r6
from turnlens.plans.registry import register
from turnlens.sources import fixtures as fx
from turnlens.sources import files


@register("unigram_freq", """
SELECT token, count, round(count * 1.0 / sum(count) OVER (), 6) AS freq FROM (
  SELECT token, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(string_split(target, ' ')) AS token FROM turn_text) GROUP BY token)""")
def unigram_freq(spark, d):
    u = A.unigram_freq(fx.turns(spark, d))
    return u.select("token", "count", r6(F.col("freq")).alias("freq"))


@register("slot_freq", """
SELECT slot, CAST(count(*) AS BIGINT) AS count, round(count(*) * 1.0 / (SELECT count(*) FROM turn_text), 6) AS freq FROM acts GROUP BY slot""")
def slot_freq(spark, d):
    return A.slot_freq(fx.turns(spark, d)).select("slot", "count", r6(F.col("freq")).alias("freq"))


@register("slot_value_tokens", """
SELECT DISTINCT slot, unnest(string_split(v, ' ')) AS token FROM (SELECT slot, unnest(vals) AS v FROM named_acts)""")
def slot_value_tokens(spark, d):
    return A.slot_value_tokens(fx.turns(spark, d))


ENTS = """ents AS (SELECT a.split, split_part(a.service, '_', 1) AS domain, a.turn_key, a.act_pos, lower(unnest(a.vals)) AS value
  FROM named_acts a JOIN perm_slots p ON p.service = a.service AND p.slot = a.slot),
unseen AS (SELECT DISTINCT value FROM ents WHERE split = 'test' AND value NOT IN (SELECT value FROM ents WHERE split = 'train'))"""


def _ents(spark, d):
    return A.entity_rows(fx.turns(spark, d), S.permissible_slots(fx.schema_slots(spark, d)))


@register("entity_counts", f"WITH {ENTS}\nSELECT split, value, CAST(count(*) AS BIGINT) AS count FROM ents GROUP BY split, value")
def entity_counts(spark, d):
    return A.entity_counts(_ents(spark, d))


@register("entity_distinct", f"WITH {ENTS}\nSELECT split, CAST(count(DISTINCT value) AS BIGINT) AS n_entities FROM ents GROUP BY split")
def entity_distinct(spark, d):
    return A.entity_distinct(_ents(spark, d))


@register("unseen_entities", f"WITH {ENTS}\nSELECT value FROM unseen")
def unseen_entities(spark, d):
    return A.unseen_entities(_ents(spark, d))


@register("entities_except", f"WITH {ENTS}\nSELECT value FROM ents WHERE split = 'test' EXCEPT SELECT value FROM ents WHERE split = 'train'")
def entities_except(spark, d):
    e = _ents(spark, d)
    return e.filter(F.col("split") == "test").select("value").subtract(e.filter(F.col("split") == "train").select("value"))


@register("unseen_counts", f"""WITH {ENTS}
SELECT value, CAST(count(*) AS BIGINT) AS count FROM ents WHERE split = 'test' AND value IN (SELECT value FROM unseen) GROUP BY value""")
def unseen_counts(spark, d):
    e = _ents(spark, d)
    return A.unseen_occurrences(e, A.unseen_entities(e)).groupBy("value").agg(F.count(F.lit(1)).alias("count"))


@register("unseen_totals", f"""WITH {ENTS}
SELECT (SELECT count(*) FROM unseen) AS n_unseen,
       (SELECT count(*) FROM ents WHERE split = 'test' AND value IN (SELECT value FROM unseen)) AS unseen_occurrences,
       (SELECT count(*) FROM ents WHERE split = 'test') AS all_occurrences""")
def unseen_totals(spark, d):
    e = _ents(spark, d)
    return A.unseen_totals(e, A.unseen_entities(e))


UBD = f"""WITH {ENTS}
SELECT domain, CAST(count(DISTINCT (turn_key, act_pos)) AS BIGINT) AS unseen_acts, CAST(count(*) AS BIGINT) AS occurrences,
       CAST(count(DISTINCT value) AS BIGINT) AS n_entities
FROM ents WHERE split = 'test' AND value IN (SELECT value FROM unseen) GROUP BY domain"""


@register("unseen_by_domain", UBD)
def unseen_by_domain(spark, d):
    e = _ents(spark, d)
    return A.unseen_by_domain(e, A.unseen_entities(e))


@register("domains_sorted", f"SELECT domain, unseen_acts FROM ({UBD}) ORDER BY unseen_acts DESC, domain")
def domains_sorted(spark, d):
    e = _ents(spark, d)
    return A.unseen_by_domain(e, A.unseen_entities(e)).orderBy(F.desc("unseen_acts"), "domain").select("domain", "unseen_acts")


@register("unseen_ratio", f"""WITH {ENTS}
SELECT n.k AS unseen_acts, t.c AS test_turns, round(n.k * 1.0 / t.c, 6) AS ratio FROM
  (SELECT CAST(count(DISTINCT (turn_key, act_pos)) AS BIGINT) AS k FROM ents WHERE split = 'test' AND value IN (SELECT value FROM unseen)) n,
  (SELECT CAST(count(*) AS BIGINT) AS c FROM turn_text WHERE split = 'test') t""")
def unseen_ratio(spark, d):
    e = _ents(spark, d)
    t = fx.turns(spark, d, splits=["test"])
    r = A.unseen_ratio(e, A.unseen_entities(e), t)
    return r.select("unseen_acts", "test_turns", r6(F.col("ratio")).alias("ratio"))


@register("top_entities", f"""WITH {ENTS}
SELECT value, CAST(count(*) AS BIGINT) AS count FROM ents WHERE split = 'train' GROUP BY value ORDER BY count DESC, value LIMIT 30""")
def top_entities(spark, d):
    c = A.entity_counts(_ents(spark, d)).filter(F.col("split") == "train").select("value", "count")
    return A.top_entities(c, 30)


DIFF = """SELECT p.dialog_id, p.turn_id, p.target, o.utterance AS original,
  CASE WHEN o.utterance IS NULL THEN 'missing' WHEN o.utterance <> p.target THEN 'diff' ELSE 'same' END AS status
FROM prepared_turns p LEFT JOIN (SELECT dialog_id, utterance, row_number() OVER (PARTITION BY dialog_id ORDER BY pos) AS ord
  FROM raw_turns WHERE speaker = 'SYSTEM') o ON o.dialog_id = p.dialog_id AND o.ord = p.turn_id"""


@register("dataset_diff", DIFF)
def dataset_diff(spark, d):
    return A.dataset_diff(fx.prepared_turns(spark, d), fx.raw_turns(spark, d))


@register("diff_counts", f"""SELECT CAST(count(*) FILTER (WHERE status = 'diff') AS BIGINT) AS n_diff,
  CAST(count(*) FILTER (WHERE status = 'missing') AS BIGINT) AS n_missing, CAST(count(*) AS BIGINT) AS n_rows FROM ({DIFF})""")
def diff_counts(spark, d):
    return A.diff_counts(A.dataset_diff(fx.prepared_turns(spark, d), fx.raw_turns(spark, d)))


@register("dialog_regroup", """
SELECT dialog_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, CAST(count(*) AS INTEGER) AS n_system,
       string_agg(utterance, ' || ' ORDER BY pos) AS utterances
FROM raw_turns WHERE speaker = 'SYSTEM' GROUP BY dialog_id""")
def dialog_regroup(spark, d):
    g = A.dialog_regroup(fx.raw_turns(spark, d))
    return g.select("dialog_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"),
                    F.size("positions").alias("n_system"), F.array_join("utterances", " || ").alias("utterances"))


@register("turn_ordinal", """
SELECT dialog_id, pos, CAST(row_number() OVER (PARTITION BY dialog_id ORDER BY pos) - 1 AS INTEGER) AS turn_id FROM raw_turns WHERE speaker = 'SYSTEM'""")
def turn_ordinal(spark, d):
    r = fx.raw_turns(spark, d).select(F.col("dialog_id"), "pos", "speaker")
    return files.system_turn_rows(r).select("dialog_id", "pos", "turn_id")


@register("turn_position", """
SELECT dialog_id, CAST(row_number() OVER (PARTITION BY dialog_id ORDER BY pos) - 1 AS INTEGER) AS idx, pos FROM raw_turns WHERE speaker = 'SYSTEM'""")
def turn_position(spark, d):
    g = A.dialog_regroup(fx.raw_turns(spark, d))
    return g.select("dialog_id", F.posexplode("positions").alias("idx", "pos"))


@register("shuffle_dialogs", "SELECT DISTINCT dialog_id FROM acts")
def shuffle_dialogs(spark, d):
    t = fx.turns(spark, d).select("dialog_id").distinct()
    return A.shuffle_rows(t, "dialog_id", seed=42)


@register("sample_rows", """
SELECT row_idx, ref, pred FROM decodes ORDER BY md5(CAST(row_idx AS VARCHAR) || ':42'), row_idx LIMIT 8""")
def sample_rows(spark, d):
    return A.sample_rows(fx.decodes(spark, d), "row_idx", 8, seed=42).select("row_idx", "ref", "pred")


TAKEN = [9, 19, 39, 69, 109, 159, 219, 289]   # test rows of the fixture (keys ending in 9)


@register("take_idx", f"SELECT row_idx, ref, pred FROM decodes WHERE row_idx IN ({', '.join(map(str, TAKEN))})")
def take_idx(spark, d):
    return A.take_idx(fx.decodes(spark, d), TAKEN).select("row_idx", "ref", "pred")


@register("case_lookup", """
SELECT r.row_idx, r.has_slot_error, d.ref FROM row_ser r JOIN decodes d ON d.row_idx = r.row_idx
WHERE r.row_idx IN (SELECT row_idx FROM decodes2 WHERE pred = ref)""")
def case_lookup(spark, d):
    cases = fx.decodes_second_run(spark, d).filter(F.col("pred") == F.col("ref"))
    return A.case_lookup(annotated(spark, d), cases).select("row_idx", "has_slot_error", "ref")


FEW = """ids AS (SELECT DISTINCT dialog_id, '5_shot' AS size FROM acts WHERE CAST(substr(dialog_id, 3) AS BIGINT) % 50 = 0
  UNION ALL SELECT DISTINCT dialog_id, '20_shot' FROM acts WHERE CAST(substr(dialog_id, 3) AS BIGINT) % 10 = 0)"""


def fewshot_ids(spark, d):
    """Few-shot id lists (FIXTURES parameters): custkey % 50 = 0 -> ``5_shot``, % 10 = 0 -> ``20_shot``."""
    ids = fx.turns(spark, d).select("dialog_id").distinct()
    k = F.substring("dialog_id", 3, 20).cast("bigint")
    return ids.filter(k % 50 == 0).withColumn("size", F.lit("5_shot")).unionByName(
        ids.filter(k % 10 == 0).withColumn("size", F.lit("20_shot")))


@register("fewshot", f"""WITH {FEW}
SELECT ids.size, t.turn_key, t.dialog_id FROM turn_text t JOIN ids ON ids.dialog_id = t.dialog_id WHERE t.split = 'train'""")
def fewshot(spark, d):
    rows = fx.turns(spark, d).filter(F.col("split") == "train").select("turn_key", "dialog_id")
    return files.fewshot(rows, fewshot_ids(spark, d)).select("size", "turn_key", "dialog_id")


@register("unseen_entity_set", f"""WITH {ENTS}
SELECT domain, value, CAST(count(*) AS BIGINT) AS occurrences FROM ents WHERE split = 'test' AND value IN (SELECT value FROM unseen) GROUP BY domain, value""")
def unseen_entity_set(spark, d):
    e = _ents(spark, d)
    return A.unseen_entity_set(e, A.unseen_entities(e))


@register("entity_sketches", f"""WITH {ENTS}
SELECT split, 'all' AS domain, CAST(count(DISTINCT value) AS BIGINT) AS n_entities, true AS within FROM ents GROUP BY split
UNION ALL SELECT split, domain, CAST(count(DISTINCT value) AS BIGINT), true FROM ents GROUP BY split, domain""")
def entity_sketches(spark, d):
    """Sketches by split and domain, merged to splits; the exact numbers and whether the estimates are within 6 %."""
    e = _ents(spark, d)
    sketches = A.entity_sketches(e)
    est = A.merged_sketches(sketches, ["split", "domain"]).unionByName(
        A.merged_sketches(sketches, ["split"]).withColumn("domain", F.lit("all")))
    exact = e.groupBy("split", "domain").agg(F.countDistinct("value").alias("n_entities")).unionByName(
        A.entity_distinct(e).withColumn("domain", F.lit("all")))
    within = F.abs(F.col("estimate") - F.col("n_entities")) <= F.greatest(F.col("n_entities") * 0.06, F.lit(1.0))
    return exact.join(est, ["split", "domain"]).select("split", "domain", "n_entities", within.alias("within"))
