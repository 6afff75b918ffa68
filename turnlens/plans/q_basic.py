"""Scans, predicates, scalar functions and simple joins (S1, S3, P*, C*, J1, J2, J5, U1)."""

from pyspark.sql import functions as F

from turnlens.functions import columns as C
from turnlens.operators import ser as S
from turnlens.operators.linearize import with_schema
from turnlens.plans.common import UNSEEN_DOMAINS, annotated
from turnlens.plans.registry import register
from turnlens.sources import fixtures as fx
from turnlens.sources import files

SEP = "|"


def _acts_long(spark, d):
    """One row per act of every turn: ``turn_key, service, act_pos, act (name), slot, values``."""
    t = fx.turns(spark, d)
    return t.select("turn_key", "service", "split", "target",
                    F.posexplode(C.decode_acts("dialog_acts")).alias("act_pos", "a")) \
        .select("turn_key", "service", "split", "target", "act_pos", "a.act", "a.slot", "a.values")


@register("scan_turns", """
SELECT turn_key, dialog_id, service, CAST(count(*) AS INTEGER) AS n_acts, max(t.target) AS target
FROM acts a JOIN (SELECT turn_key AS k, target FROM turn_text) t ON t.k = a.turn_key
WHERE split = 'test' GROUP BY turn_key, dialog_id, service""")
def scan_turns(spark, d):
    t = files.scan_turns(fx.turns(spark, d), splits=["test"])
    return t.select("turn_key", "dialog_id", "service", F.size("dialog_acts").alias("n_acts"), "target")


@register("schema_slots", """
SELECT service, slot, slot_desc, is_categorical, possible_values,
       CAST(len(CASE WHEN possible_values = '' THEN [] ELSE string_split(possible_values, ',') END) AS INTEGER) AS n_possible
FROM schema_slots""")
def schema_slots_q(spark, d):
    s = fx.schema_slots(spark, d)
    nested = files.nest_schema(s)
    flat = files.flatten_schema(nested)
    return flat.select("service", "slot", "slot_desc", "is_categorical",
                       F.array_join("possible_values", ",").alias("possible_values"),
                       F.size("possible_values").alias("n_possible"))


@register("act_names", "SELECT turn_key, act_pos, act_name FROM named_acts")
def act_names_q(spark, d):
    """P1 with the act table joined in as data."""
    t = C.decode_with_table(fx.turns(spark, d).select("turn_key", "dialog_acts"), fx.act_names(spark))
    return t.select("turn_key", F.posexplode("dialog_acts").alias("act_pos", "a")).select("turn_key", "act_pos", F.col("a.act").alias("act_name"))


@register("domain_of", "SELECT DISTINCT service, split_part(service, '_', 1) AS domain FROM acts")
def domain_of_q(spark, d):
    return fx.turns(spark, d).select("service").distinct().select("service", C.domain_of("service").alias("domain"))


@register("system_turns", "SELECT dialog_id, pos, utterance FROM raw_turns WHERE speaker = 'SYSTEM'")
def system_turns(spark, d):
    return fx.raw_turns(spark, d).filter(F.col("speaker") == "SYSTEM").select("dialog_id", "pos", "utterance")


@register("vstripe", """
SELECT row_idx, replace(concat(ref, ' | ', pred), '|', '<vstripe>') AS escaped,
       replace(replace(concat(ref, ' | ', pred), '|', '<vstripe>'), '<vstripe>', '|') = concat(ref, ' | ', pred) AS roundtrip
FROM decodes""")
def vstripe(spark, d):
    dec = fx.decodes(spark, d)
    x = F.concat("ref", F.lit(" | "), "pred")
    return dec.select("row_idx", C.escape_pipes(x).alias("escaped"),
                      (C.unescape_pipes(C.escape_pipes(x)) == x).alias("roundtrip"))


@register("clean_ws", """
SELECT conv_id, turn, translate(text, chr(10) || chr(9), '  ') AS text FROM conversations""")
def clean_ws(spark, d):
    c = fx.table(spark, d, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", C.clean_ws("text").alias("text"))


@register("goodbye_override", """
SELECT row_idx, CASE WHEN contains(sr, 'GOODBYE') THEN ref ELSE pred END AS pred FROM decodes""")
def goodbye_override(spark, d):
    dec = fx.decodes(spark, d)
    return dec.select("row_idx", C.goodbye_override("sr", "ref", "pred").alias("pred"))


@register("slot_examples", "SELECT a.turn_key, t.target FROM acts a JOIN turn_text t ON t.turn_key = a.turn_key WHERE a.slot = 'brand'")
def slot_examples(spark, d):
    from turnlens.operators.analysis import slot_examples as op
    return op(fx.turns(spark, d), "brand").select("turn_key", "target")


@register("mark_unseen", """
SELECT DISTINCT split_part(service, '_', 1) AS domain,
  CASE WHEN split_part(service, '_', 1) IN ('Automobile', 'Machinery') THEN concat(split_part(service, '_', 1), '*')
       ELSE split_part(service, '_', 1) END AS label FROM acts""")
def mark_unseen(spark, d):
    return (fx.turns(spark, d).select(C.domain_of("service").alias("domain")).distinct()
            .select("domain", C.mark_unseen("domain", UNSEEN_DOMAINS).alias("label")))


@register("bad_cases_flag", "SELECT row_idx, domain FROM row_ser WHERE has_slot_error")
def bad_cases_flag(spark, d):
    from turnlens.operators.analysis import bad_cases
    return bad_cases(annotated(spark, d), by="has_slot_error", limit=0).select("row_idx", "domain")


@register("bad_cases_domain", """
SELECT r.row_idx, d.ref, d.pred FROM row_ser r JOIN decodes d ON d.row_idx = r.row_idx
WHERE r.has_slot_error AND r.domain = 'Machinery' ORDER BY r.row_idx LIMIT 20""")
def bad_cases_domain(spark, d):
    from turnlens.operators.analysis import bad_cases_of_domain
    return bad_cases_of_domain(annotated(spark, d), "Machinery", ["row_idx", "ref", "pred"], 20)


@register("contains_ci", """
SELECT a.turn_key, a.act_pos, contains(lower(t.pred), lower(a.value1)) AS contained
FROM acts a JOIN turn_text t ON t.turn_key = a.turn_key WHERE a.value1 IS NOT NULL""")
def contains_ci(spark, d):
    a = fx.acts(spark, d).filter(F.col("value1").isNotNull())
    t = fx.turn_text(spark, d).select("turn_key", "pred")
    return a.join(t, "turn_key").select("turn_key", "act_pos", C.contains_ci("pred", "value1").alias("contained"))


def _joined(expr):
    return f"array_to_string({expr}, '{SEP}')"


@register("token_windows", f"""
SELECT row_idx, {_joined("list_transform(range(1, len(string_split(pred, ' ')) + 1), lambda i: array_to_string(string_split(pred, ' ')[i:i + 1], ' '))")} AS windows
FROM decodes""")
def token_windows(spark, d):
    dec = fx.decodes(spark, d)
    return dec.select("row_idx", F.array_join(C.token_windows(C.sp_tokens("pred"), 2), SEP).alias("windows"))


@register("ws_tokens", f"""
SELECT conv_id, turn, CAST(len(tk) AS INTEGER) AS n_tokens, {_joined("tk")} AS tokens
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tk FROM conversations)""")
def ws_tokens(spark, d):
    c = fx.table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", C.ws_tokens("text").alias("tk"))
    return c.select("conv_id", "turn", F.size("tk").alias("n_tokens"), F.array_join("tk", SEP).alias("tokens"))


@register("sp_tokens", f"""
SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens, {_joined("string_split(text, ' ')")} AS tokens
FROM conversations""")
def sp_tokens(spark, d):
    c = fx.table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", C.sp_tokens("text").alias("tk"))
    return c.select("conv_id", "turn", F.size("tk").alias("n_tokens"), F.array_join("tk", SEP).alias("tokens"))


@register("sentences", f"""
SELECT conv_id, turn, CAST(len(string_split(text, '.')) AS INTEGER) AS n_sentences, {_joined("string_split(text, '.')")} AS sentences
FROM conversations""")
def sentences(spark, d):
    c = fx.table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", C.sentences("text").alias("s"))
    return c.select("conv_id", "turn", F.size("s").alias("n_sentences"), F.array_join("s", SEP).alias("sentences"))


@register("schema_union", """
SELECT service, slot, CASE WHEN service LIKE 'A%' THEN slot_desc || ' (test)' WHEN service LIKE 'B%' THEN slot_desc
    ELSE slot_desc || ' (dev)' END AS slot_desc,
  NOT is_categorical OR (slot = 'in_stock' AND service NOT LIKE 'B%') AS permissible FROM schema_slots""")
def schema_union(spark, d):
    """U1 over three schemas that differ: train has all services, dev all but B, test those with A.

    dev calls ``in_stock`` non-categorical; dev and test describe the slots in their own words.
    """
    s = fx.schema_slots(spark, d)
    dev = s.filter(~F.col("service").startswith("B")) \
        .withColumns({"slot_desc": F.concat("slot_desc", F.lit(" (dev)")),
                      "is_categorical": F.col("is_categorical") & (F.col("slot") != "in_stock")})
    test = s.filter(F.col("service").startswith("A")).withColumn("slot_desc", F.concat("slot_desc", F.lit(" (test)")))
    u = files.union_schemas([x.withColumn("schema_order", F.lit(i)) for i, x in enumerate([s, dev, test])])
    return u.select("service", "slot", "slot_desc", "permissible")


@register("permissible_acts", """
SELECT a.turn_key, a.act_pos, a.slot FROM acts a JOIN perm_slots p ON p.service = a.service AND p.slot = a.slot""")
def permissible_acts(spark, d):
    a = S.with_permissible(_acts_long(spark, d), fx.schema_slots(spark, d))
    return a.filter(F.coalesce(F.array_contains("perm", F.col("slot")), F.lit(False))).select("turn_key", "act_pos", "slot")


@register("join_slot_desc", """
SELECT a.turn_key, a.act_pos, a.slot, s.slot_desc FROM acts a LEFT JOIN schema_slots s ON s.service = a.service AND s.slot = a.slot""")
def join_slot_desc(spark, d):
    t = with_schema(fx.turns(spark, d), fx.schema_slots(spark, d))
    return t.select("turn_key", F.posexplode("dialog_acts").alias("act_pos", "a"), "slot_desc") \
        .select("turn_key", "act_pos", F.col("a.slot").alias("slot"), F.element_at("slot_desc", F.col("a.slot")).alias("slot_desc"))


@register("join_decodes", """
SELECT d.row_idx, d.ref, d.service, CAST(count(*) AS INTEGER) AS n_acts FROM decodes d JOIN acts a ON a.turn_key = d.row_idx
GROUP BY d.row_idx, d.ref, d.service""")
def join_decodes(spark, d):
    t = fx.turns(spark, d, splits=["test"])
    j = S.join_decodes(fx.decodes(spark, d), t)
    return j.select("row_idx", "ref", "service", F.size("dialog_acts").alias("n_acts"))


@register("feature_select", "SELECT turn_key, target AS input_text FROM turn_text")
def feature_select(spark, d):
    from turnlens.operators.tokens import feature_select as op
    t = fx.turns(spark, d).withColumn("_linearized", F.col("target"))
    return op(t, {"_linearized": "input_text"}, ["turn_key", "input_text"])
