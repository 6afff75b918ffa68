"""Raw dialogues -> task rows (S2, S7, L6-L16): every frame of every system turn.

A frame is one service's acts with its own service call.  A turn's frames stay
in its row (they are few) and look their service's texts or templates up in one
map by service, so no turn is shuffled or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions.columns import clean_ws
from turnlens.operators import linearize as L
from turnlens.schemas import TSV_SEPARATOR
from turnlens.sources import files

REPRESENTATIONS = ("naive", "schema_guided", "t2g2")


def noncategorical(schema_slots: DataFrame) -> DataFrame:
    """``service, noncat ARRAY<STRING>``: slots that delexicalisation replaces."""
    return schema_slots.filter(~F.col("is_categorical")).groupBy("service").agg(F.collect_set("slot").alias("noncat"))


def by_service(services: DataFrame) -> Column:
    """One row per service -> ``MAP<service, STRUCT<the row>>``, made once (bounded by the number of services)."""
    row = F.struct("service", F.struct(*services.columns))
    return services.where("service IS NOT NULL").select(F.map_from_entries(F.collect_list(row))).scalar()


def task_rows_of_dialogues(dialogues: DataFrame, representation: str, schema_slots: DataFrame | None = None,
                           templates: DataFrame | None = None, delex: bool = False, canonical: bool = False,
                           dialog_ids: DataFrame | None = None) -> DataFrame:
    """``input, target, metainfo, dialog_id, turn_id`` of every system turn of raw dialogues.

    ``schema_slots`` is needed by ``schema_guided`` and ``delex``, ``templates``
    by ``t2g2``.  ``delex`` replaces values of non-categorical slots: in the
    target by the first frame's acts, and in the rendered templates.
    ``canonical`` fills templates with canonical values.  A turn with frames of
    several services is an error unless templates are used; so are services
    without schema or templates.  ``metainfo`` is the whole turn as JSON.
    """
    if representation not in REPRESENTATIONS:
        raise ValueError(f"unknown representation: {representation}")
    turns = files.dialogue_system_turns(dialogues, dialog_ids)
    if representation != "t2g2":
        services = F.array_distinct(F.transform("frames", lambda f: f["service"]))
        several = F.raise_error(F.concat(F.lit("several services in a turn of dialogue "), F.col("dialog_id")))
        turns = turns.where(F.when(F.size(services) > 1, several.cast("boolean")).otherwise(True))
    if delex:
        turns = turns.withColumn("_noncat", by_service(noncategorical(schema_slots)))
    if representation == "schema_guided":
        turns = turns.withColumn("_service", by_service(L.slot_strings(schema_slots).drop("slot_strs")))
    elif representation == "t2g2":
        turns = turns.withColumn("_service", by_service(L.template_maps(templates)))

    def noncat(service):
        return F.coalesce(F.element_at("_noncat", service)["noncat"], F.array().cast("array<string>")) if delex else None

    # A frame with what its service has, found once per frame and not once per act.
    found = F.transform("frames", lambda f: F.struct(
        f["service"].alias("service"), f["actions"].alias("actions"), f["service_call"]["method"].alias("method"),
        *([noncat(f["service"]).alias("noncat")] if delex else []),
        *([F.element_at("_service", f["service"]).alias("of")] if representation != "naive" else [])))

    def text(f):
        if representation == "naive":
            out = L.frame_naive(f["actions"], f["service"])
        elif representation == "schema_guided":
            unknown = F.raise_error(F.concat(F.lit("no schema for service "), f["service"]))
            out = F.when(f["of"]["service_str"].isNull(), unknown) \
                .otherwise(L.frame_schema(f["actions"], f["of"]["service_str"], f["of"]["slot_str"]))
        else:
            out = L.lin_template(f["actions"], f["service"], f["of"]["tmpl"], f["method"], f["noncat"] if delex else None, canonical)
        return F.when(f["service"].isNotNull(), out)

    texts = F.transform(found, text)
    first = F.get("frames", F.lit(0))
    target = L.delexicalize("utterance", first["actions"], noncat(first["service"])) if delex else F.col("utterance")
    between = " " if representation == "t2g2" else TSV_SEPARATOR
    source = F.concat_ws(TSV_SEPARATOR, F.col("speaker"), F.nullif(F.concat_ws(between, texts), F.lit("")))
    meta = F.to_json(F.struct("speaker", "utterance", "frames"))
    return turns.select(clean_ws(source).alias("input"), clean_ws(target).alias("target"), clean_ws(meta).alias("metainfo"),
                        "dialog_id", F.col("turn_id").cast("int").alias("turn_id"))
