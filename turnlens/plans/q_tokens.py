"""Token keys."""

from pyspark.sql import functions as F

from turnlens.functions.columns import decode_acts
from turnlens.operators import tokens as TK
from turnlens.operators.template_predictor import template_input, template_predictor
from turnlens.plans.q_linearize import TEMPLATE_TEXT
from turnlens.plans.registry import register
from turnlens.sources import fixtures as fx

WS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"
VOC = f"""voc AS (SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + 3 AS BIGINT) AS id FROM
  (SELECT token, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest({WS.format(x='target')}) AS token FROM turn_text) GROUP BY token))"""


def enc_sql(col: str, name: str) -> str:
    return f"""{name} AS (SELECT x.row_idx, list_append(list(coalesce(v.id, 2) ORDER BY x.i), 1) AS ids
  FROM (SELECT row_idx, tk, unnest(range(1, len(tk) + 1)) AS i FROM (SELECT row_idx, {WS.format(x=col)} AS tk FROM decodes)) x
  LEFT JOIN voc v ON v.token = x.tk[x.i] GROUP BY x.row_idx)"""


def ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _voc(spark, d):
    return TK.vocab(fx.turns(spark, d), "target")


def _encoded(spark, d, col, out):
    return TK.encode_ids(fx.decodes(spark, d), _voc(spark, d), "row_idx", col, out)


@register("vocab", f"WITH {VOC}\nSELECT token, count, id FROM voc")
def vocab(spark, d):
    return _voc(spark, d)


@register("encode_ids", f"""WITH {VOC}, {enc_sql('pred', 'enc')}
SELECT row_idx, array_to_string(ids, ',') AS input_ids, CAST(len(ids) AS INTEGER) AS n_attention FROM enc""")
def encode_ids(spark, d):
    e = _encoded(spark, d, "pred", "input_ids")
    return e.select("row_idx", ids_str("input_ids").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attention"))


@register("decode_ids", f"""SELECT row_idx, array_to_string({WS.format(x='ref')}, ' ') AS text FROM decodes""")
def decode_ids(spark, d):
    voc = _voc(spark, d)
    e = TK.encode_ids(fx.decodes(spark, d), voc, "row_idx", "ref", "labels")
    return TK.decode_ids(e, voc, "row_idx", "labels", "text").select("row_idx", "text")


CAUSAL = f"""WITH {VOC}, {enc_sql('pred', 'ei')}, {enc_sql('ref', 'el')},
cl AS (SELECT ei.row_idx, list_concat(ei.ids, [1], el.ids, [1]) AS input_ids,
  list_concat(list_transform(range(len(ei.ids) + 1), lambda x: -100), el.ids, [1]) AS labels, len(ei.ids) + 1 AS n_in
  FROM ei JOIN el ON el.row_idx = ei.row_idx)"""


def _causal(spark, d):
    voc = _voc(spark, d)
    e = TK.encode_columns(fx.decodes(spark, d), voc, "row_idx", {"pred": "input_ids", "ref": "labels"})
    return TK.causal_lm_rows(e, bos=TK.EOS_ID, eos=TK.EOS_ID)


@register("causal_lm_rows", CAUSAL + """
SELECT row_idx, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels,
  CAST(len(input_ids) AS INTEGER) AS n_attention, CAST(n_in AS INTEGER) AS n_raw_input,
  CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_raw_label FROM cl""")
def causal_lm_rows(spark, d):
    c = _causal(spark, d)
    s = lambda col: F.aggregate(col, F.lit(0), lambda a, x: a + x)
    return c.select("row_idx", ids_str("input_ids").alias("input_ids"), ids_str("labels").alias("labels"),
                    s("attention_mask").alias("n_attention"), s("raw_input_mask").alias("n_raw_input"),
                    s("raw_label_mask").alias("n_raw_label"))


@register("mask_select", CAUSAL + """
SELECT row_idx, array_to_string(list_filter(labels, lambda x: x <> -100), ',') AS selected FROM cl""")
def mask_select(spark, d):
    c = _causal(spark, d)
    return c.select("row_idx", ids_str(TK.mask_select("labels", "raw_label_mask")).alias("selected"))


@register("pad_rows", f"""WITH {VOC}, {enc_sql('pred', 'enc')}
SELECT row_idx, array_to_string(CASE WHEN len(ids) >= 32 THEN ids ELSE list_concat(ids, list_transform(range(32 - len(ids)), lambda x: 0)) END, ',') AS ids
FROM enc""")
def pad_rows(spark, d):
    e = _encoded(spark, d, "pred", "input_ids")
    return e.select("row_idx", ids_str(TK.pad_to("input_ids", TK.PAD_ID, 32)).alias("ids"))


@register("split_generated", """
SELECT row_idx, split_part(sr || '<|endoftext|>' || pred, '<|endoftext|>', 1) AS inp,
       split_part(sr || '<|endoftext|>' || pred, '<|endoftext|>', 2) AS pred FROM decodes""")
def split_generated(spark, d):
    g = fx.decodes(spark, d).select("row_idx", F.concat("sr", F.lit("<|endoftext|>"), "pred").alias("g"))
    return g.select("row_idx", TK.split_generated("g", 0).alias("inp"), TK.split_generated("g", 1).alias("pred"))


@register("batches", """
SELECT row_idx, pred, CAST((row_number() OVER (ORDER BY row_idx) - 1) // 16 AS BIGINT) AS batch_id FROM decodes""")
def batches(spark, d):
    b = TK.batches(fx.decodes(spark, d).select("pred", "row_idx"), "row_idx", 16)
    return b.select("row_idx", "pred", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("batches_shuffled", """
SELECT row_idx, pred, CAST((row_number() OVER (ORDER BY md5(CAST(row_idx AS VARCHAR) || ':7'), row_idx) - 1) // 16 AS BIGINT) AS batch_id
FROM decodes""")
def batches_shuffled(spark, d):
    """T9 in training mode: a seeded shuffle of the rows, then batches."""
    b = TK.batches(fx.decodes(spark, d).select("pred", "row_idx"), "row_idx", 16, shuffle=True, seed=7)
    return b.select("row_idx", "pred", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("pad_batches", f"""WITH {VOC}, {enc_sql('pred', 'enc')},
cut AS (SELECT row_idx, CASE WHEN len(ids) > 12 THEN list_append(ids[1:11], 1) ELSE ids END AS ids FROM enc),
b AS (SELECT row_idx, ids, (row_number() OVER (ORDER BY row_idx) - 1) // 16 AS batch_id FROM cut),
m AS (SELECT batch_id, max(len(ids)) AS longest FROM b GROUP BY batch_id)
SELECT row_idx, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(longest - len(ids)), lambda x: 0)), ',') AS mask
FROM b JOIN m ON m.batch_id = b.batch_id""")
def pad_batches(spark, d):
    """T1 truncation to 12 ids (the end id stays), T9 batches, padding to the longest row of each batch."""
    e = TK.encode_ids(fx.decodes(spark, d), _voc(spark, d), "row_idx", "pred", "input_ids", max_length=12, truncation=True)
    b = TK.batches(e.select("row_idx", "input_ids", "attention_mask"), "row_idx", 16)
    p = TK.pad_batch(b, {"input_ids": TK.PAD_ID, "attention_mask": 0}, mode="longest")
    return p.select("row_idx", ids_str("input_ids").alias("ids"), ids_str("attention_mask").alias("mask"))


def _echo_lower(s):
    """Built-in demo predictor: lowercases its input (a model would be called here)."""
    return s.str.lower()


@register("batch_predict", "SELECT row_idx, sr, lower(sr) AS pred FROM decodes")
def batch_predict(spark, d):
    return TK.batch_predict(fx.decodes(spark, d), "row_idx", "sr", _echo_lower, "pred")


@register("template_predict", f"SELECT d.row_idx, t.text AS pred FROM decodes d JOIN ({TEMPLATE_TEXT}) t ON t.turn_key = d.row_idx")
def template_predict(spark, d):
    """The test turns scored by the template predictor."""
    rows = fx.decodes(spark, d, with_acts=True).withColumn("dialog_acts", decode_acts("dialog_acts")) \
        .select("row_idx", template_input().alias("input"))
    setup = template_predictor(fx.templates(spark, d), fx.FRAME_INTENT)
    return TK.batch_predict(rows, "row_idx", "input", setup=setup).select("row_idx", "pred")
