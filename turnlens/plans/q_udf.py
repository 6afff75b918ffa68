"""Alignment-metric keys (Arrow UDFs): fuzzy SER, token-sort ratio, ROUGE-L, METEOR, PARENT, annotated cases."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.operators import analysis as A
from turnlens.operators import bootstrap as B
from turnlens.operators import ngram as N
from turnlens.operators import ser as S
from turnlens.operators import textmetrics as TM
from turnlens.plans.common import annotated, r6
from turnlens.plans.registry import register
from turnlens.plans.sqlgen import bootstrap_sql, ngram_ctes, rouge_tok
from turnlens.sources import fixtures as fx
from turnlens.sources import files


@register("token_sort_ratio")
def token_sort_ratio(spark, d):
    dec = fx.decodes(spark, d)
    return dec.select("row_idx", TM.token_sort_ratio("ref", "pred").alias("ratio"))


@register("fuzzy_match")
def fuzzy_match(spark, d):
    """Every permissible value of a decode row, fuzzy-matched against the lowercased prediction."""
    rows = annotated(spark, d)
    perm = F.coalesce(F.col("perm"), F.array().cast("array<string>"))
    vals = rows.select("row_idx", F.lower("pred").alias("pred"), F.posexplode(F.flatten(F.transform(
        F.filter("dialog_acts", lambda a: F.array_contains(perm, a["slot"])), lambda a: a["values"]))).alias("vi", "value")) \
        .withColumn("value", F.lower("value"))
    return TM.fuzzy_value_matches(vals, ["row_idx", "vi"])


@register("ser_fuzzy")
def ser_fuzzy(spark, d):
    f = TM.ser_fuzzy_rows(annotated(spark, d), keep=["domain"])
    return S.ser_by(f, ["domain"], "ser_fuzzy", coalesce_null=True).select("domain", r6(F.col("ser")).alias("ser_fuzzy"))


# Longest common subsequence by rows of the table: lists of one number step through both texts.
LCS = """list_reduce(list_concat([list_transform(range(len(r) + 1), lambda z: 0)], list_transform(range(1, len(h) + 1), lambda i: [i])),
  lambda prev, i: list_reduce(list_concat([[0]], list_transform(range(1, len(r) + 1), lambda j: [j])),
    lambda cur, j: list_append(cur, greatest(cur[len(cur)], CASE WHEN h[i[1]] = r[j[1]] THEN prev[j[1]] + 1 ELSE prev[j[1] + 1] END))))[len(r) + 1]"""


@register("rouge_l", f"""
WITH t AS (SELECT {rouge_tok('ref')} AS r, {rouge_tok('pred')} AS h FROM decodes),
s AS (SELECT CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0.0 ELSE CAST({LCS} AS DOUBLE) / len(h) END AS p,
             CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0.0 ELSE CAST({LCS} AS DOUBLE) / len(r) END AS c FROM t)
SELECT round(avg(p), 6) AS rougeL_prec, round(avg(c), 6) AS rougeL_recall,
       round(avg(p), 6) AS rougeLsum_prec, round(avg(c), 6) AS rougeLsum_recall FROM s""")
def rouge_l(spark, d):
    r = TM.rouge_l_rows(fx.decodes(spark, d))
    return r.agg(r6(F.avg("rougeL_prec")).alias("rougeL_prec"), r6(F.avg("rougeL_recall")).alias("rougeL_recall"),
                 r6(F.avg("rougeL_prec")).alias("rougeLsum_prec"), r6(F.avg("rougeL_recall")).alias("rougeLsum_recall"))


ROUGE_L_ROWS = f"""SELECT row_idx, CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0.0 ELSE CAST({LCS} AS DOUBLE) / len(h) END AS rougeL_prec,
  CASE WHEN len(r) = 0 OR len(h) = 0 THEN 0.0 ELSE CAST({LCS} AS DOUBLE) / len(r) END AS rougeL_recall
  FROM (SELECT row_idx, {rouge_tok('ref')} AS r, {rouge_tok('pred')} AS h FROM decodes)"""
ROUGE_NAMES = {f"rouge{n}_{k}": f"rouge{n}-{k}" for n in "12L" for k in ("prec", "recall")}


@register("rouge_bootstrap", f"""WITH {ngram_ctes("SELECT row_idx, ref, pred FROM decodes", rouge_tok('ref'), rouge_tok('pred'), [1, 2], 'rg')},
rl AS ({ROUGE_L_ROWS}),
vals AS (SELECT rg.row_idx, m1 * 1.0 / greatest(h1, 1) AS rouge1_prec, m1 * 1.0 / greatest(r1, 1) AS rouge1_recall,
  m2 * 1.0 / greatest(h2, 1) AS rouge2_prec, m2 * 1.0 / greatest(r2, 1) AS rouge2_recall, rougeL_prec, rougeL_recall FROM rg JOIN rl ON rl.row_idx = rg.row_idx),
{bootstrap_sql('vals', 'row_idx', ROUGE_NAMES, B.REPLICATES, B.SEED, B.PER_HASH, B.POISSON, B.CONFIDENCE)}""")
def rouge_bootstrap(spark, d):
    """Low, middle and high end of the 95 % bootstrap interval of every ROUGE score."""
    dec = fx.decodes(spark, d)
    parts = [(N.rouge_n_rows(dec), "12"), (TM.rouge_l_rows(dec), "L")]
    found = [B.bootstrap(rows, "row_idx", {c: name for c, name in ROUGE_NAMES.items() if c[5] in orders}) for rows, orders in parts]
    return found[0].unionByName(found[1]).select("metric", *[r6(F.col(c)).alias(c) for c in ("low", "mid", "high")])


@register("meteor")
def meteor(spark, d):
    return TM.meteor_rows(fx.decodes(spark, d)).agg(r6(F.avg("meteor")).alias("meteor"))


#: Words that stand for one another in the decodes' phrases: a parameter of the query.
SYNONYMS = [("the", "the"), ("its", "the"), ("goodbye", "bye"), ("thanks", "bye")]


@register("meteor_stages")
def meteor_stages(spark, d):
    """A10 with all stages: equal words, stems, synonym groups."""
    table = spark.createDataFrame(SYNONYMS, "word string, group string")
    rows = TM.meteor_rows(fx.decodes(spark, d), stem=True, synonyms=table)
    return rows.select("row_idx", r6(F.col("meteor")).alias("meteor"))


@register("act_table", """
SELECT t.turn_key, coalesce(x.tbl, '') AS tbl FROM (SELECT DISTINCT turn_key FROM acts) t LEFT JOIN (
  SELECT turn_key, string_agg(concat(slot, '=', array_to_string(tk, ' ')), ';' ORDER BY act_pos) AS tbl FROM (
    SELECT turn_key, act_pos, slot, list_filter(flatten(list_transform(vals, lambda v: list_filter(regexp_split_to_array(v, '\\s+'), lambda x: x <> ''))),
           lambda x: lower(x) NOT IN ('true', 'false')) AS tk
    FROM named_acts WHERE slot <> 'intent') WHERE slot <> '' AND len(tk) > 0 GROUP BY turn_key) x ON x.turn_key = t.turn_key""")
def act_table(spark, d):
    t = fx.turns(spark, d)
    tb = TM.act_table("dialog_acts")
    return t.select("turn_key", F.array_join(F.transform(tb, lambda r: F.concat(r["attr"][0], F.lit("="), F.array_join(r["value"], " "))), ";").alias("tbl"))


def _parent(spark, d):
    return TM.parent_rows(annotated(spark, d))


PARENT_TOKENS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
#: PARENT of every row: the reference text stands in the prediction's place (a), the prediction in the reference's (b).
PARENT_ROWS = f"""entry AS (SELECT turn_key, act_pos, list_filter(flatten(list_transform(vals, lambda v: {PARENT_TOKENS.format(x='v')})),
    lambda w: lower(w) NOT IN ('true', 'false')) AS r FROM named_acts WHERE slot NOT IN ('intent', '')),
entries AS (SELECT * FROM entry WHERE len(r) > 0),
known AS (SELECT turn_key, flatten(list(r)) AS words FROM entries GROUP BY turn_key),
sides AS (SELECT row_idx, {PARENT_TOKENS.format(x='ref')} AS a, {PARENT_TOKENS.format(x='pred')} AS b, words FROM decodes JOIN known ON turn_key = row_idx),
pairs AS (SELECT * FROM sides WHERE len(a) > 0),
grams AS (SELECT row_idx, n, array_to_string(t[i:i + n - 1], chr(1)) AS g, max(len(list_filter(t[i:i + n - 1], lambda x: list_contains(words, x))) / n) AS w,
    count(*) FILTER (s = 'a') AS ca, count(*) FILTER (s = 'b') AS cb FROM (
  SELECT row_idx, words, s, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (
    SELECT row_idx, words, 'a' AS s, a AS t FROM pairs UNION ALL SELECT row_idx, words, 'b', b FROM pairs), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY 1, 2, 3),
orders AS (SELECT row_idx, n, sum(ca * w + least(ca, cb) * (1 - w)) AS pn, sum(ca) AS pd, sum(least(ca, cb) * w) AS rn, sum(cb * w) AS rd FROM grams GROUP BY 1, 2),
shares AS (SELECT p.row_idx, k.n, CASE WHEN coalesce(pd, 0) = 0 THEN 0.0 ELSE pn / pd END AS ps, CASE WHEN coalesce(rd, 0) = 0 THEN 1.0 ELSE rn / rd END AS rs
  FROM pairs p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k LEFT JOIN orders o ON o.row_idx = p.row_idx AND o.n = k.n),
means AS (SELECT row_idx, CASE WHEN min(ps) FILTER (n = 1) = 0 THEN 0.0 ELSE exp(sum(ln(CASE WHEN ps = 0 THEN 0.00001 ELSE ps END)) / 4) END AS p,
  CASE WHEN min(rs) FILTER (n = 1) = 0 THEN 0.0 ELSE exp(sum(ln(CASE WHEN rs = 0 THEN 0.00001 ELSE rs END)) / 4) END AS r FROM shares GROUP BY row_idx),
held AS (SELECT row_idx, avg({LCS} / len(r)) AS t FROM (SELECT row_idx, e.r, a AS h FROM pairs JOIN entries e ON e.turn_key = row_idx) GROUP BY row_idx),
scored AS (SELECT m.row_idx, p, CASE WHEN r = 0 THEN 0.0 ELSE exp(0.5 * ln(r) + 0.5 * ln(CASE WHEN t = 0 THEN 0.00001 ELSE t END)) END AS r
  FROM means m JOIN held h ON h.row_idx = m.row_idx),
parent_rows AS (SELECT row_idx, p AS precision, r AS recall, 2 * p * r / (p + r + 0.00000001) AS fscore FROM scored)"""


@register("parent", f"""WITH {PARENT_ROWS}
SELECT round_even(avg(precision), 3) AS parent_precision, round_even(avg(recall), 3) AS parent_recall, round_even(avg(fscore), 3) AS parent_fscore
FROM parent_rows""")
def parent(spark, d):
    p = _parent(spark, d)
    return p.agg(F.bround(F.avg("parent_precision"), 3).alias("parent_precision"),
                 F.bround(F.avg("parent_recall"), 3).alias("parent_recall"),
                 F.bround(F.avg("parent_fscore"), 3).alias("parent_fscore"))


def _cases(spark, d):
    """Decode rows + domain, strict and fuzzy flags, PARENT scores (left join J3), rounded half-even."""
    rows = annotated(spark, d)
    fz = TM.ser_fuzzy_rows(rows)
    p = TM.parent_rows(rows).select("row_idx", *[F.bround(c, 3).alias(c) for c in
                                                 ["parent_precision", "parent_recall", "parent_fscore"]])
    return rows.select("row_idx", "ref", "pred", "sr", "domain", "has_slot_error") \
        .join(fz, "row_idx", "left").join(p, "row_idx", "left")


@register("parent_cases", f"""WITH {PARENT_ROWS}
SELECT r.row_idx, r.domain, r.has_slot_error, round(precision, 6) AS parent_precision, round(recall, 6) AS parent_recall, round(fscore, 6) AS parent_fscore
FROM row_ser r LEFT JOIN parent_rows p ON p.row_idx = r.row_idx""")
def parent_cases(spark, d):
    """Every decode row with its PARENT scores; null where the row has no table or no reference."""
    rows = annotated(spark, d)
    scores = TM.parent_rows(rows).select("row_idx", *[r6(F.col(c)).alias(c) for c in ("parent_precision", "parent_recall", "parent_fscore")])
    return rows.select("row_idx", "domain", "has_slot_error").join(scores, "row_idx", "left")


@register("annotated_cases")
def annotated_cases(spark, d):
    return _cases(spark, d)


CASE_ROW = T.StructType([T.StructField(n, t) for n, t in [
    ("row_idx", T.LongType()), ("ref", T.StringType()), ("pred", T.StringType()), ("sr", T.StringType()),
    ("domain", T.StringType()), ("has_slot_error", T.BooleanType()), ("ser_fuzzy", T.BooleanType()),
    ("parent_precision", T.DoubleType()), ("parent_recall", T.DoubleType()), ("parent_fscore", T.DoubleType())]])


@register("case_files", """
SELECT r.row_idx, d.ref, d.pred, d.sr, r.domain, r.has_slot_error, 'r1---t1' AS run FROM row_ser r JOIN decodes d ON d.row_idx = r.row_idx""")
def case_files(spark, d):
    """The annotated cases written as CSV and read back (all columns but the alignment scores are compared)."""
    from turnlens.plans.q_files import scratch
    out = os.path.join(scratch(spark, "cases"), "r1", "t1", "annotated_cases.csv")
    files.write_metrics(_cases(spark, d), out)
    return files.read_results(spark, out, CASE_ROW).select("row_idx", "ref", "pred", "sr", "domain", "has_slot_error", "run")


@register("bad_cases_parent")
def bad_cases_parent(spark, d):
    """P11 by PARENT precision: the 20 worst cases."""
    return A.bad_cases(_cases(spark, d), "parent_precision", 20).select("row_idx", "parent_precision", "parent_recall")


@register("run_summary_full")
def run_summary_full(spark, d):
    """All metrics of a run: the SQL-checked rows of ``run_summary``, fuzzy SER, METEOR, ROUGE-L and PARENT."""
    from turnlens.plans.q_metrics import run_summary
    dec = fx.decodes(spark, d, with_acts=True)
    cases = _cases(spark, d)
    rouge = TM.rouge_l_rows(dec)
    parts = [
        A.metric_rows(cases, {"ser-fuzzy": F.avg(F.coalesce("ser_fuzzy", F.lit(False)).cast("int")),
                              **{c.replace("_", "-"): F.bround(F.avg(c), 3)
                                 for c in ("parent_precision", "parent_recall", "parent_fscore")}}),
        A.metric_rows(TM.meteor_rows(dec), {"meteor": F.avg("meteor")}),
        A.metric_rows(rouge, {f"{n}-{k}": F.avg(f"rougeL_{k}") for n in ("rougeL", "rougeLsum") for k in ("prec", "recall")}),
    ]
    out = run_summary(spark, d).select("metric", "value")
    for p in parts:
        out = out.unionByName(p.withColumn("value", r6(F.col("value"))))
    return out


WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


@register("parent_export", f"""
WITH tab AS (SELECT turn_key, list([[slot], tk] ORDER BY act_pos) AS tbl FROM (
  SELECT turn_key, act_pos, slot, list_filter(flatten(list_transform(vals, lambda v: {WORDS.format(x='v')})),
         lambda w: lower(w) NOT IN ('true', 'false')) AS tk
  FROM named_acts WHERE slot <> 'intent') WHERE slot <> '' AND len(tk) > 0 GROUP BY turn_key),
kept AS (SELECT {WORDS.format(x='ref')} AS r, {WORDS.format(x='pred')} AS p, tbl FROM decodes JOIN tab ON turn_key = row_idx)
SELECT file, text FROM (SELECT 'table.jl' AS file, CAST(to_json(tbl) AS VARCHAR) AS text, r FROM kept
  UNION ALL SELECT 'ref.txt', CAST(to_json(r) AS VARCHAR), r FROM kept UNION ALL SELECT 'pred.txt', CAST(to_json(p) AS VARCHAR), r FROM kept)
WHERE len(r) > 0""")
def parent_export(spark, d):
    from turnlens.plans.q_files import scratch
    out = scratch(spark, "parent")
    files.parent_export(_parent(spark, d), out)
    parts = [spark.read.text(os.path.join(out, f)).select(F.lit(f).alias("file"), F.col("value").alias("text"))
             for f in ("table.jl", "ref.txt", "pred.txt")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
