"""A predictor that renders templates inside the scoring job.

``template_predictor`` gives ``batch_predict`` its ``setup``: the templates (their number is checked) are
broadcast, each Python worker unpacks them once, and every Arrow batch of inputs is rendered without a
join. The input of a row is the JSON text of its service and acts (``template_input``), so the predictor
stands where a model's would, and a model can replace it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.schemas import (ACT_PREFERENCE_ORDER, CONFIRM_PREFIX, INTENT_CONDITIONED_ACTS, KEY_SEPARATOR, LITERAL_KEY_VALUES,
                              VALUE_CHAR)

#: Templates that are sent to the workers, at most.
MOST_TEMPLATES = 200_000
RANK = {name: i for i, name in enumerate(ACT_PREFERENCE_ORDER)}


def template_input(service: str = "service", acts: str = "dialog_acts") -> Column:
    """The predictor's input: JSON of a turn's service and named acts."""
    return F.to_json(F.struct(F.col(service).alias("service"), F.col(acts).alias("acts")))


def key_of(act: dict, intent: str | None) -> str:
    """The template key of one act (the rules of L10 and L13)."""
    name, slot, values = act["act"], act.get("slot") or "", act.get("values") or []
    if name in INTENT_CONDITIONED_ACTS:
        own = values[0] if name == "OFFER_INTENT" and slot == "intent" else intent
        if own is None:
            raise ValueError(f"no intent given for act {name}")
        count = ["count", VALUE_CHAR] if name == "INFORM_COUNT" else []
        return KEY_SEPARATOR.join([name, own, *count])
    if not slot:
        return name
    if not values:
        return KEY_SEPARATOR.join([name, slot])
    if values[0] in LITERAL_KEY_VALUES:
        if len(values) != 1:
            raise ValueError(f"more than one value for literal slot {slot}")
        return KEY_SEPARATOR.join([name, slot, values[0]])
    return KEY_SEPARATOR.join([name, slot, VALUE_CHAR * len(values)])


def filled(template: str, values: list[str]) -> str:
    """Placeholders from left to right take the values; values are never expanded again."""
    first, *rest = template.split(VALUE_CHAR)
    if len(rest) > len(values):
        raise ValueError(f"too few values for template: {template}")
    return first + "".join(v + part for v, part in zip(values, rest))


def render(text: str | None, table: dict, intent: str | None) -> str | None:
    """The text of one input; an act without a template is an error, a null input gives null."""
    if text is None:
        return None
    turn = json.loads(text)
    service, acts = turn.get("service"), turn.get("acts") or []
    parts = [CONFIRM_PREFIX] if any(a["act"] == "CONFIRM" for a in acts) else []
    for act in sorted(acts, key=lambda a: RANK.get(a["act"], len(RANK))):
        key = key_of(act, intent)
        if (service, key) not in table:
            raise ValueError(f"service {service} has no template with key {key}")
        parts.append(filled(table[service, key], act.get("values") or []))
    return " ".join(parts)


def template_predictor(templates: DataFrame, intent: str | None = None,
                       most: int = MOST_TEMPLATES) -> Callable[[], Callable[[pd.Series], pd.Series]]:
    """``setup`` for ``batch_predict``; more than ``most`` templates are an error. Of equal keys the largest text counts."""
    rows = templates.groupBy("service", "act_key").agg(F.max("template").alias("template")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates: join them instead (lin_template)")
    sent = templates.sparkSession.sparkContext.broadcast({(r["service"], r["act_key"]): r["template"] for r in rows})

    def setup() -> Callable[[pd.Series], pd.Series]:
        table = sent.value
        return lambda inputs: pd.Series([render(x if isinstance(x, str) else None, table, intent) for x in inputs], dtype=object)

    return setup
