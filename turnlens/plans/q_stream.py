"""Streaming keys (R1): per-domain SER and BLEU maintained by a Structured Streaming aggregation."""

from pyspark.sql import functions as F

from turnlens.operators import ser as S
from turnlens.plans.common import r6
from turnlens.plans.q_files import scratch
from turnlens.plans.q_metrics import BLEU_CTE
from turnlens.plans.registry import register
from turnlens.plans.sqlgen import bleu_select
from turnlens.sources import fixtures as fx
from turnlens.operators.metric_state import MetricState
from turnlens.streaming.metrics_stream import run_stream, run_stream_once, scores


STATE_SQL = f"""WITH {BLEU_CTE}
SELECT s.domain, ser, ser_applicable, bleu, seq_accuracy, n_rows FROM (
  SELECT r.domain, round(avg(CAST(has_slot_error AS INTEGER)), 6) AS ser, round(avg(CAST(ser_applicable AS INTEGER)), 6) AS ser_applicable,
    round(avg(CAST(d.ref = d.pred AS INTEGER)) * 100, 6) AS seq_accuracy, CAST(count(*) AS BIGINT) AS n_rows
  FROM row_ser r JOIN decodes d ON d.row_idx = r.row_idx GROUP BY r.domain) s JOIN ({bleu_select('domain')}) b ON b.domain = s.domain"""


def _decoded(spark, d):
    return fx.decodes(spark, d, with_acts=True).select("row_idx", "ref", "pred", "service", "dialog_acts")


def _rounded(scores_):
    return scores_.select("domain", *[r6(F.col(c)).alias(c) for c in ("ser", "ser_applicable", "bleu", "seq_accuracy")], "n_rows")


@register("metric_state", STATE_SQL)
def metric_state(spark, d):
    """The rows of each customer segment's services added as a batch of their own, one of them twice; computed once."""
    rows = _decoded(spark, d)
    perm = S.permissible_slots(fx.schema_slots(spark, d))
    state = MetricState(spark, f"{scratch(spark, 'state')}/sums")
    for number in "123":  # services end in their region's number
        state.add_batch(rows.where(F.substring_index("service", "_", -1) == number), perm, f"region-{number}")
    state.add_batch(rows.where(F.substring_index("service", "_", -1) == "2"), perm, "region-2")
    return _rounded(state.compute(["domain"]))


@register("stream_once", STATE_SQL)
def stream_once(spark, d):
    """All decode files are delivered twice under different names; every row counts once."""
    work = scratch(spark, "stream-once")
    rows = _decoded(spark, d)
    for _ in range(2):
        rows.write.mode("append").parquet(f"{work}/source")
    perm = S.permissible_slots(fx.schema_slots(spark, d))
    return _rounded(run_stream_once(spark, f"{work}/source", perm, work).compute(["domain"]))


def _run(spark, d, bleu):
    work = scratch(spark, "stream")
    src = f"{work}/source"
    rows = fx.decodes(spark, d, with_acts=True).select("row_idx", "ref", "pred", "service", "dialog_acts")
    rows.write.mode("overwrite").parquet(src)
    perm = S.permissible_slots(fx.schema_slots(spark, d))
    return scores(run_stream(spark, src, perm, work, bleu=bleu))


@register("stream_ser", "SELECT domain, round(avg(CAST(has_slot_error AS INTEGER)), 6) AS ser FROM row_ser GROUP BY domain")
def stream_ser(spark, d):
    return _run(spark, d, False).select("domain", r6(F.col("ser")).alias("ser"))


@register("stream_bleu", f"WITH {BLEU_CTE}\n{bleu_select('domain')}")
def stream_bleu(spark, d):
    return _run(spark, d, True).select("domain", r6(F.col("bleu")).alias("bleu"))
