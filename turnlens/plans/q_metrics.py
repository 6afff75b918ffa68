"""Metric keys: BLEU (corpus, by domain), ROUGE-1/2, sequence accuracy, run summary and comparisons."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import domain_of
from turnlens.operators import analysis as A
from turnlens.operators import ngram as N
from turnlens.operators import ser as S
from turnlens.plans.common import annotated, r6
from turnlens.plans.registry import register
from turnlens.plans.sqlgen import bleu_select, ngram_ctes, rouge_tok, tok13a
from turnlens.sources import files
from turnlens.sources import fixtures as fx

DEC = "SELECT row_idx, ref, pred, split_part(service, '_', 1) AS domain FROM decodes"
BLEU_CTE = ngram_ctes(DEC, tok13a("ref"), tok13a("pred"), [1, 2, 3, 4], "st")
ROUGE_CTE = ngram_ctes(DEC, rouge_tok("ref"), rouge_tok("pred"), [1, 2], "rg")
ROUGE_ROWS = """rr AS (SELECT row_idx, domain, m1 * 1.0 / greatest(h1, 1) AS rouge1_prec, m1 * 1.0 / greatest(r1, 1) AS rouge1_recall,
  m2 * 1.0 / greatest(h2, 1) AS rouge2_prec, m2 * 1.0 / greatest(r2, 1) AS rouge2_recall FROM rg)"""


def dec_domain(spark, d, decodes=None):
    """Decode rows with their domain (J2 join to the test turns)."""
    dec = decodes if decodes is not None else fx.decodes(spark, d)
    return dec.withColumn("domain", domain_of("service"))


@register("bleu_corpus", f"WITH {BLEU_CTE}\n{bleu_select(None)}")
def bleu_corpus(spark, d):
    st = N.bleu_row_stats(dec_domain(spark, d))
    return N.bleu_agg(st).select(r6(F.col("bleu")).alias("bleu"))


@register("bleu_by_domain", f"WITH {BLEU_CTE}\n{bleu_select('domain')}")
def bleu_by_domain(spark, d):
    st = N.bleu_row_stats(dec_domain(spark, d), keep=["domain"])
    return N.bleu_agg(st, ["domain"]).select("domain", r6(F.col("bleu")).alias("bleu"))


@register("rouge_n", f"""WITH {ROUGE_CTE}, {ROUGE_ROWS}
SELECT round(avg(rouge1_prec), 6) AS rouge1_prec, round(avg(rouge1_recall), 6) AS rouge1_recall,
       round(avg(rouge2_prec), 6) AS rouge2_prec, round(avg(rouge2_recall), 6) AS rouge2_recall FROM rr""")
def rouge_n(spark, d):
    rows = N.rouge_n_rows(fx.decodes(spark, d))
    return rows.agg(*[r6(F.avg(c)).alias(c) for c in ["rouge1_prec", "rouge1_recall", "rouge2_prec", "rouge2_recall"]])


@register("seq_accuracy", "SELECT round(avg(CAST(ref = pred AS INTEGER)) * 100, 6) AS seq_accuracy FROM decodes2")
def seq_accuracy(spark, d):
    dec = fx.decodes_second_run(spark, d)
    return dec.agg(r6(N.seq_accuracy("ref", "pred")).alias("seq_accuracy"))


@register("bad_cases_sorted", f"""WITH {ROUGE_CTE}, {ROUGE_ROWS}
SELECT row_idx, round(rouge1_recall, 6) AS rouge1_recall FROM rr ORDER BY rouge1_recall ASC NULLS LAST, row_idx LIMIT 20""")
def bad_cases_sorted(spark, d):
    rows = N.rouge_n_rows(fx.decodes(spark, d))
    return A.bad_cases_sorted(rows, "rouge1_recall", 20).select("row_idx", r6(F.col("rouge1_recall")).alias("rouge1_recall"))


RUN_LABEL_PATH = "runs/t5small/naive/test_name/test_case.txt"


def run_label(path: str):
    """Run label = path parts 1 and 3 joined by ``---``."""
    parts = F.split(F.lit(path), "/")
    return F.concat(F.element_at(parts, 2), F.lit("---"), F.element_at(parts, 4))


def _summary(spark, d, decodes):
    rows = annotated(spark, d, decodes)
    ser = rows.agg(S.ser_rate(F.col("has_slot_error")).alias("value")).select(F.lit("ser").alias("metric"), "value")
    bleu = N.bleu_agg(N.bleu_row_stats(decodes)).select(F.lit("bleu").alias("metric"), F.col("bleu").alias("value"))
    rg = N.rouge_n_rows(decodes)
    rouge = A.metric_rows(rg, {
        "rouge1-prec": F.avg("rouge1_prec"), "rouge1-recall": F.avg("rouge1_recall"),
        "rouge2-prec": F.avg("rouge2_prec"), "rouge2-recall": F.avg("rouge2_recall")})
    acc = decodes.agg(N.seq_accuracy("ref", "pred").alias("value")).select(F.lit("seq_accuracy").alias("metric"), "value")
    return ser.unionByName(bleu).unionByName(rouge).unionByName(acc)


SUMMARY_SQL = lambda src: f"""WITH {ngram_ctes(src, tok13a('ref'), tok13a('pred'), [1, 2, 3, 4], 'st')},
{ngram_ctes(src, rouge_tok('ref'), rouge_tok('pred'), [1, 2], 'rg')},
{ROUGE_ROWS}
SELECT 'ser' AS metric, avg(CAST(r.has_slot_error AS INTEGER)) AS value FROM row_ser r JOIN ({src}) s ON s.row_idx = r.row_idx
UNION ALL SELECT 'bleu', bleu FROM ({bleu_select(None)})
UNION ALL SELECT 'rouge1-prec', avg(rouge1_prec) FROM rr UNION ALL SELECT 'rouge1-recall', avg(rouge1_recall) FROM rr
UNION ALL SELECT 'rouge2-prec', avg(rouge2_prec) FROM rr UNION ALL SELECT 'rouge2-recall', avg(rouge2_recall) FROM rr
UNION ALL SELECT 'seq_accuracy', avg(CAST(ref = pred AS INTEGER)) * 100 FROM ({src})"""


@register("run_summary", f"""SELECT metric, 't5small---test_name' AS run, round(value, 6) AS value FROM ({SUMMARY_SQL(DEC)})""")
def run_summary(spark, d):
    s = _summary(spark, d, fx.decodes(spark, d, with_acts=True))
    return s.select("metric", run_label(RUN_LABEL_PATH).alias("run"), r6(F.col("value")).alias("value"))


DEC2 = "SELECT row_idx, ref, pred, split_part(service, '_', 1) AS domain FROM decodes2"
ROW_SER2 = """row_ser2 AS (SELECT d.row_idx, coalesce(bool_or(list_bool_or(list_transform(a.vals, lambda v: NOT contains(lower(d.pred), lower(v))))), false) AS has_slot_error
  FROM decodes2 d LEFT JOIN (SELECT a.* FROM named_acts a JOIN perm_slots p ON p.service = a.service AND p.slot = a.slot) a ON a.turn_key = d.row_idx
  GROUP BY d.row_idx)"""


@register("metric_compare", f"""
SELECT b.metric, round(b.value, 6) AS base, round(o.value, 6) AS second FROM ({SUMMARY_SQL(DEC)}) b
LEFT JOIN ({SUMMARY_SQL(DEC2).replace('FROM row_ser r', 'FROM row_ser2 r').replace('WITH ', 'WITH ' + ROW_SER2 + ', ', 1)}) o ON o.metric = b.metric""")
def metric_compare(spark, d):
    base = _summary(spark, d, fx.decodes(spark, d, with_acts=True))
    other = _summary(spark, d, fx.decodes_second_run(spark, d, with_acts=True))
    j = A.metric_compare(base, other, "second")
    return j.select("metric", r6(F.col("value")).alias("base"), r6(F.col("second")).alias("second"))


@register("domain_metrics", f"""WITH {BLEU_CTE}
SELECT s.domain, round(s.ser, 6) AS ser, b.bleu FROM (SELECT domain, avg(CAST(has_slot_error AS INTEGER)) AS ser FROM row_ser GROUP BY domain) s
JOIN ({bleu_select('domain')}) b ON b.domain = s.domain""")
def domain_metrics(spark, d):
    ser = S.ser_by(annotated(spark, d), ["domain"])
    bleu = N.bleu_agg(N.bleu_row_stats(dec_domain(spark, d), keep=["domain"]), ["domain"])
    return ser.join(bleu, "domain").select("domain", r6(F.col("ser")).alias("ser"), r6(F.col("bleu")).alias("bleu"))


DOMAINS = ["Automobile", "Building", "Furniture", "Household", "Machinery"]


def _domain_long(spark, d):
    ser = S.ser_by(annotated(spark, d), ["domain"]).select(F.lit("ser").alias("metric"), "domain", F.col("ser").alias("value"))
    bleu = N.bleu_agg(N.bleu_row_stats(dec_domain(spark, d), keep=["domain"]), ["domain"]) \
        .select(F.lit("bleu").alias("metric"), "domain", F.col("bleu").alias("value"))
    return ser.unionByName(bleu)


DOMAIN_LONG_SQL = f"""WITH {BLEU_CTE}, lng AS (
SELECT 'ser' AS metric, domain, avg(CAST(has_slot_error AS INTEGER)) AS value FROM row_ser GROUP BY domain
UNION ALL SELECT 'bleu', domain, bleu FROM ({bleu_select('domain')}))"""


@register("domain_pivot", DOMAIN_LONG_SQL + "\nSELECT metric, " + ", ".join(
    f"round(max(CASE WHEN domain = '{x}' THEN value END), 6) AS {x}" for x in DOMAINS) + " FROM lng GROUP BY metric")
def domain_pivot(spark, d):
    w = A.domain_pivot(_domain_long(spark, d), "value", DOMAINS)
    return w.select("metric", *[r6(F.col(x)).alias(x) for x in w.columns if x != "metric"])


@register("domain_union", DOMAIN_LONG_SQL.replace("WITH ", f"WITH {ROW_SER2}, ", 1) + """
SELECT 'first' AS model_name, metric, domain, round(value, 6) AS value FROM lng
UNION ALL SELECT 'second', 'ser', domain, round(avg(CAST(s.has_slot_error AS INTEGER)), 6) FROM row_ser2 s JOIN row_ser r ON r.row_idx = s.row_idx GROUP BY domain""")
def domain_union(spark, d):
    long = _domain_long(spark, d).withColumn("value", r6(F.col("value")))
    second = S.ser_by(annotated(spark, d, fx.decodes_second_run(spark, d, with_acts=True)), ["domain"]) \
        .select(F.lit("ser").alias("metric"), "domain", r6(F.col("ser")).alias("value"))
    return A.domain_union({"first": long, "second": second}).select("model_name", "metric", "domain", "value")


@register("compare_runs", f"""WITH {ROW_SER2}
SELECT r.row_idx, d.pred, d2.pred AS pred_second, s2.has_slot_error AS has_slot_error_second
FROM row_ser r JOIN decodes d ON d.row_idx = r.row_idx LEFT JOIN decodes2 d2 ON d2.row_idx = r.row_idx
LEFT JOIN row_ser2 s2 ON s2.row_idx = r.row_idx WHERE r.has_slot_error""")
def compare_runs(spark, d):
    base = A.bad_cases(annotated(spark, d), "has_slot_error", 0).select("row_idx", "pred")
    other = annotated(spark, d, fx.decodes_second_run(spark, d, with_acts=True))
    return A.compare_runs(base, {"second": other}, ["pred", "has_slot_error"])


@register("domain_files", f"""WITH {BLEU_CTE}
SELECT s.domain, round(s.ser, 6) AS ser, b.bleu, 'r1---t1' AS run FROM (SELECT domain, avg(CAST(has_slot_error AS INTEGER)) AS ser FROM row_ser GROUP BY domain) s
JOIN ({bleu_select('domain')}) b ON b.domain = s.domain""")
def domain_files(spark, d):
    """The domain metrics written as CSV and read back."""
    from turnlens.plans.q_files import scratch
    out = f"{scratch(spark, 'domains')}/r1/t1/domain_metrics.csv"
    files.write_metrics(domain_metrics(spark, d), out)
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("ser", T.DoubleType()),
                           T.StructField("bleu", T.DoubleType())])
    return files.read_results(spark, out, schema)


DOC_PAIRS = """SELECT a.doc_id AS row_idx, a.lang, a.text AS ref, b.text AS pred
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"""


@register("bleu_long_text", f"WITH {ngram_ctes(DOC_PAIRS, tok13a('ref'), tok13a('pred'), [1, 2, 3, 4], 'st')}\n{bleu_select('lang')}")
def bleu_long_text(spark, d):
    """A8/A9 on long natural text: each document scored against the next one, BLEU per language.

    Whole texts (up to 20,000 words) go through the same explode -> count plan;
    the pairing is an equi join on ``doc_id + 1``.
    """
    docs = fx.table(spark, d, "documents", ["doc_id", "lang", "text"])
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("pred"))
    pairs = docs.join(nxt, "doc_id").select(F.col("doc_id").alias("row_idx"), "lang", F.col("text").alias("ref"), "pred")
    st = N.bleu_row_stats(pairs, keep=["lang"])
    return N.bleu_agg(st, ["lang"]).select("lang", r6(F.col("bleu")).alias("bleu"))
