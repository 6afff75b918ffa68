"""SER keys: slot_error, ser_overall, ser_by_domain, ser_by_tag, ser_applicable, permissible_slots ..."""

from pyspark.sql import functions as F

from turnlens.functions.columns import seen_tag
from turnlens.operators import ser as S
from turnlens.plans.common import UNSEEN_DOMAINS, annotated, r6
from turnlens.plans.registry import register
from turnlens.sources import fixtures as fx


@register("permissible_slots", """
SELECT service, array_to_string(list_sort(list(DISTINCT slot)), ',') AS slots
FROM schema_slots WHERE NOT is_categorical GROUP BY service""")
def permissible_slots(spark, d):
    p = S.permissible_slots(fx.schema_slots(spark, d))
    return p.select("service", F.array_join("slots", ",").alias("slots"))


@register("slot_error", "SELECT row_idx, domain, has_slot_error FROM row_ser")
def slot_error(spark, d):
    return annotated(spark, d).select("row_idx", "domain", "has_slot_error")


@register("ser_overall", """
SELECT round(avg(CAST(has_slot_error AS INTEGER)), 6) AS ser, CAST(count(*) AS BIGINT) AS n_rows FROM row_ser""")
def ser_overall(spark, d):
    return annotated(spark, d).agg(r6(S.ser_rate(F.col("has_slot_error"))).alias("ser"),
                                   F.count(F.lit(1)).alias("n_rows"))


@register("ser_by_domain", """
SELECT domain, round(avg(CAST(has_slot_error AS INTEGER)), 6) AS ser FROM row_ser GROUP BY domain""")
def ser_by_domain(spark, d):
    return S.ser_by(annotated(spark, d), ["domain"]).select("domain", r6(F.col("ser")).alias("ser"))


@register("ser_applicable", """
SELECT domain, round(avg(CAST(ser_applicable AS INTEGER)), 6) AS ser,
       CAST(count(ser_applicable) AS BIGINT) AS n_applicable FROM row_ser GROUP BY domain""")
def ser_applicable(spark, d):
    rows = annotated(spark, d)
    return rows.groupBy("domain").agg(r6(S.ser_rate(F.col("ser_applicable"))).alias("ser"),
                                      F.count("ser_applicable").alias("n_applicable"))


_TAG = "CASE WHEN domain IN ('Automobile','Machinery') THEN 'unseen' ELSE 'seen' END"


@register("ser_by_tag", f"""
SELECT coalesce(tag, 'overall') AS tag, round(avg(CAST(has_slot_error AS INTEGER)) * 100, 6) AS ser
FROM (SELECT {_TAG} AS tag, has_slot_error FROM row_ser) GROUP BY ROLLUP (tag)""")
def ser_by_tag(spark, d):
    rows = annotated(spark, d).withColumn("tag", seen_tag("domain", UNSEEN_DOMAINS))
    return S.ser_by_tag(rows).select("tag", r6(F.col("ser")).alias("ser"))


@register("seen_tag", f"SELECT row_idx, {_TAG} AS tag FROM row_ser")
def seen_tag_q(spark, d):
    return annotated(spark, d).select("row_idx", seen_tag("domain", UNSEEN_DOMAINS).alias("tag"))


@register("metric_modes", """
SELECT domain, round(avg(CAST(ser_applicable AS INTEGER)), 6) AS ser_strict FROM row_ser GROUP BY domain""")
def metric_modes(spark, d):
    m = S.ser_metric("ser_strict")
    s = m.summary(annotated(spark, d), ["domain"])
    return s.select("domain", r6(F.col("ser_strict")).alias("ser_strict"))
