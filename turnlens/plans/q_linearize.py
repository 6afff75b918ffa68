"""Linearizer keys (L1-L17, J1, J9, S4 check, S7 task rows)."""

from pyspark.sql import functions as F

from turnlens.functions.columns import decode_acts
from turnlens.operators import linearize as L
from turnlens.plans.registry import register
from turnlens.sources import fixtures as fx
from turnlens.sources import files

def _intent():
    return F.lit(fx.FRAME_INTENT)


def _turns(spark, d):
    return fx.turns(spark, d).withColumn("dialog_acts", decode_acts("dialog_acts"))


@register("lin_naive", """
SELECT turn_key, string_agg(concat(act_name, ' ', slot, ' ', array_to_string(vals, ' ')), ' <SEP> ' ORDER BY act_pos) AS text
FROM named_acts GROUP BY turn_key""")
def lin_naive(spark, d):
    return _turns(spark, d).select("turn_key", L.lin_naive("dialog_acts").alias("text"))


PAPER = """CASE WHEN len(vals) > 0 THEN concat(act_name, ' ( ', {s}, ' = ', array_to_string(vals, ' '), ' )')
  WHEN slot <> '' THEN concat(act_name, ' ( ', {s}, ' )') ELSE act_name END"""


@register("lin_paper", "SELECT turn_key, sr AS text FROM paper_text")
def lin_paper(spark, d):
    return _turns(spark, d).select("turn_key", L.lin_paper("dialog_acts").alias("text"))


SCHEMA_TEXT = f"""SELECT t.turn_key, coalesce(x.text, '') AS text FROM (SELECT DISTINCT turn_key, service FROM acts) t LEFT JOIN (
  SELECT turn_key, string_agg({PAPER.format(s='sd')}, ' ' ORDER BY act_pos) AS text
  FROM (SELECT a.*, CASE WHEN a.slot IN ('', 'count', 'intent') THEN a.slot ELSE s.slot_desc END AS sd, s.slot AS known
        FROM named_acts a LEFT JOIN schema_slots s ON s.service = a.service AND s.slot = a.slot)
  WHERE slot IN ('', 'count', 'intent') OR known IS NOT NULL GROUP BY turn_key) x ON x.turn_key = t.turn_key"""


@register("lin_schema", SCHEMA_TEXT)
def lin_schema(spark, d):
    t = L.with_schema(_turns(spark, d), fx.schema_slots(spark, d))
    return t.select("turn_key", L.lin_schema("dialog_acts", "slot_desc").alias("text"))


@register("lin_schema_svc", f"""
WITH st AS ({SCHEMA_TEXT.replace('SELECT t.turn_key,', 'SELECT t.turn_key, t.service,', 1)}),
sd AS (SELECT DISTINCT service, service_desc FROM schema_slots)
SELECT st.turn_key, concat('SERVICE ( ', st.service, ' = ', sd.service_desc, ' ) ', st.text) AS text
FROM st JOIN sd ON sd.service = st.service""")
def lin_schema_svc(spark, d):
    t = L.with_schema(_turns(spark, d), fx.schema_slots(spark, d))
    return t.select("turn_key", L.lin_schema_svc("dialog_acts", "service", "service_desc", "slot_desc").alias("text"))


TSV_ACT = """CASE WHEN len(vals) > 0 THEN concat(CASE WHEN slot <> '' THEN concat(lower(act_name), ',', {s}) ELSE lower(act_name) END, ', values = ', array_to_string(vals, ','))
  ELSE CASE WHEN slot <> '' THEN concat(lower(act_name), ',', {s}) ELSE lower(act_name) END END"""


@register("lin_tsv_naive", f"""
SELECT turn_key, concat('SYSTEM | service_name=', service, ' | ', string_agg({TSV_ACT.format(s='slot')}, ' | ' ORDER BY act_pos)) AS text
FROM named_acts GROUP BY turn_key, service""")
def lin_tsv_naive(spark, d):
    return _turns(spark, d).select("turn_key", L.lin_tsv_naive("dialog_acts", "service").alias("text"))


SLOT_STR = """concat('name=', s.slot, ',description=', s.slot_desc,
  CASE WHEN s.possible_values <> '' THEN concat(',examples =', s.possible_values) ELSE '' END)"""


@register("lin_tsv_schema", f"""
SELECT turn_key, concat('SYSTEM | service_name=', service, ',description={{schema[''description'']}} | ',
  string_agg({TSV_ACT.format(s='ss')}, ' | ' ORDER BY act_pos)) AS text
FROM (SELECT a.*, CASE WHEN s.slot IS NULL THEN a.slot ELSE {SLOT_STR} END AS ss FROM named_acts a
      LEFT JOIN schema_slots s ON s.service = a.service AND s.slot = a.slot) GROUP BY turn_key, service""")
def lin_tsv_schema(spark, d):
    t = _turns(spark, d).join(L.slot_strings(fx.schema_slots(spark, d)), "service", "left")
    return t.select("turn_key", L.lin_tsv_schema("dialog_acts", "service_str", "slot_str").alias("text"))


@register("schema_string", f"""
SELECT service, lower(concat('service_name=', service, ',description={{schema[''description'']}} | ',
  string_agg({SLOT_STR}, ' | ' ORDER BY s.slot_pos))) AS text
FROM schema_slots s GROUP BY service""")
def schema_string(spark, d):
    s = L.slot_strings(fx.schema_slots(spark, d))
    return s.select("service", L.schema_string("service_str", "slot_strs").alias("text"))


# ------------------------------------------------------------------ templates

KEY = """CASE WHEN act_name IN ('NOTIFY_FAILURE', 'NOTIFY_SUCCESS', 'INFORM_COUNT', 'OFFER_INTENT')
    THEN concat(act_name, '!!', CASE WHEN act_name = 'OFFER_INTENT' AND slot = 'intent' THEN vals[1] ELSE 'FindParts' END,
                CASE WHEN act_name = 'INFORM_COUNT' THEN '!!count!!@' ELSE '' END)
  WHEN slot <> '' THEN concat(act_name, '!!', slot, CASE WHEN len(vals) = 0 THEN ''
    WHEN vals[1] IN ('True', 'False', 'dontcare') THEN concat('!!', vals[1]) ELSE concat('!!', repeat('@', len(vals))) END)
  ELSE act_name END"""
RANK = """CASE act_name WHEN 'SELECT' THEN 0 WHEN 'INFORM_COUNT' THEN 1 WHEN 'NOTIFY_SUCCESS' THEN 2 WHEN 'NOTIFY_FAILURE' THEN 3
  WHEN 'INFORM' THEN 4 WHEN 'REQUEST' THEN 5 WHEN 'CONFIRM' THEN 6 ELSE 7 END"""
FILL = """array_to_string(list_transform(range(1, len(string_split(template, '@')) + 1),
  lambda i: coalesce(list_prepend('', vals)[i], '') || string_split(template, '@')[i]), '')"""
RENDERED = f"""SELECT a.turn_key, a.act_pos, a.service, a.act_name, {RANK} AS rnk, k.act_key, t.template, {FILL} AS text
FROM (SELECT *, {KEY} AS act_key FROM named_acts) a
JOIN (SELECT turn_key, act_pos, act_key FROM (SELECT *, {KEY} AS act_key FROM named_acts)) k ON k.turn_key = a.turn_key AND k.act_pos = a.act_pos
LEFT JOIN templates t ON t.service = a.service AND t.act_key = a.act_key"""


def _with_templates(spark, d):
    return _turns(spark, d).join(L.template_maps(fx.templates(spark, d)), "service", "left")


@register("template_key", f"SELECT turn_key, act_pos, {KEY} AS act_key FROM named_acts")
def template_key(spark, d):
    t = _turns(spark, d).select("turn_key", F.posexplode("dialog_acts").alias("act_pos", "a"))
    return t.select("turn_key", "act_pos", L.template_key(F.col("a"), L.act_intent(F.col("a"), _intent())).alias("act_key"))


@register("join_templates", f"SELECT turn_key, act_pos, act_key, template FROM ({RENDERED})")
def join_templates(spark, d):
    t = _with_templates(spark, d).select("turn_key", "tmpl", F.posexplode("dialog_acts").alias("act_pos", "a"))
    k = L.template_key(F.col("a"), L.act_intent(F.col("a"), _intent()))
    return t.select("turn_key", "act_pos", k.alias("act_key"), F.element_at("tmpl", k).alias("template"))


@register("template_fill", f"SELECT turn_key, act_pos, text FROM ({RENDERED})")
def template_fill(spark, d):
    t = _with_templates(spark, d).select("turn_key", "service", "tmpl", F.posexplode("dialog_acts").alias("act_pos", "a"))
    return t.select("turn_key", "act_pos", L.render_act(F.col("a"), F.col("service"), F.col("tmpl"), _intent()).alias("text"))


@register("act_order", f"""
SELECT turn_key, string_agg(act_name, ',' ORDER BY {RANK}, act_pos) AS acts FROM named_acts GROUP BY turn_key""")
def act_order(spark, d):
    t = _turns(spark, d)
    return t.select("turn_key", F.array_join(F.transform(L.act_order("dialog_acts"), lambda a: a["act"]), ",").alias("acts"))


TEMPLATE_TEXT = f"""SELECT turn_key, concat(CASE WHEN bool_or(act_name = 'CONFIRM') THEN 'Please confirm the following details: ' ELSE '' END,
  string_agg(text, ' ' ORDER BY rnk, act_pos)) AS text FROM ({RENDERED}) GROUP BY turn_key"""


@register("lin_template", TEMPLATE_TEXT)
def lin_template(spark, d):
    t = _with_templates(spark, d)
    return t.select("turn_key", L.lin_template("dialog_acts", "service", "tmpl", _intent()).alias("text"))


@register("lin_tsv_t2g2", f"SELECT turn_key, concat('SYSTEM | ', text) AS text FROM ({TEMPLATE_TEXT})")
def lin_tsv_t2g2(spark, d):
    t = _with_templates(spark, d)
    return t.select("turn_key", L.lin_tsv_t2g2("dialog_acts", "service", "tmpl", _intent()).alias("text"))


@register("templates_check", """
SELECT service, act_key, length(act_key) - length(replace(act_key, '@', '')) = length(template) - length(replace(template, '@', '')) AS consistent
FROM templates""")
def templates_check(spark, d):
    return files.check_templates(fx.templates(spark, d), strict=False).select("service", "act_key", "consistent")


@register("delex", """
WITH ranked AS (
  SELECT a.turn_key, a.slot, a.vals, p.slot IS NOT NULL AS noncat, row_number() OVER (PARTITION BY a.turn_key ORDER BY
    coalesce(list_position(['SELECT', 'INFORM_COUNT', 'NOTIFY_SUCCESS', 'NOTIFY_FAILURE', 'INFORM', 'REQUEST', 'CONFIRM'], a.act_name), 99),
    a.act_pos) AS r
  FROM named_acts a LEFT JOIN (SELECT DISTINCT service, slot FROM schema_slots WHERE NOT is_categorical) p
    ON p.service = a.service AND p.slot = a.slot),
steps AS (SELECT turn_key, flatten(list(list_transform(list_filter(vals, lambda v: v <> ''),
    lambda v: v || chr(1) || CASE WHEN noncat THEN '<' || slot || '>' ELSE v END) ORDER BY r)) AS xs FROM ranked GROUP BY turn_key)
SELECT t.turn_key, list_reduce(list_concat([t.target], coalesce(s.xs, [])),
    lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) AS target
FROM turn_text t LEFT JOIN steps s ON s.turn_key = t.turn_key""")
def delex(spark, d):
    """L15 over the targets: non-categorical values -> ``<slot>``."""
    s = fx.schema_slots(spark, d)
    noncat = s.filter(~F.col("is_categorical")).groupBy("service").agg(F.collect_set("slot").alias("noncat"))
    t = _turns(spark, d).join(noncat, "service", "left") \
        .withColumn("noncat", F.coalesce("noncat", F.array().cast("array<string>")))
    return t.select("turn_key", L.delexicalize("target", "dialog_acts", "noncat").alias("target"))


@register("task_rows", f"""
SELECT x.text AS input, t.target AS target, t.dialog_id, CAST(t.turn_id AS INTEGER) AS turn_id
FROM (SELECT turn_key, dialog_id, target, row_number() OVER (PARTITION BY dialog_id ORDER BY turn_key) - 1 AS turn_id FROM turn_text) t
JOIN ({TEMPLATE_TEXT}) x ON x.turn_key = t.turn_key""")
def task_rows(spark, d):
    """S7 rows for the t2g2 representation (``SYSTEM | `` + template text); metainfo omitted from the check."""
    from pyspark.sql import Window
    t = _with_templates(spark, d)
    t = t.withColumn("turn_id", F.row_number().over(Window.partitionBy("dialog_id").orderBy("turn_key")) - 1)
    rows = files.task_rows(t, L.lin_template("dialog_acts", "service", "tmpl", _intent()), F.col("target"))
    return rows.select("input", "target", "dialog_id", "turn_id")


# ------------------------------------------------------------------ L17

SVC_TEXT = f"""SELECT st.turn_key, concat('SERVICE ( ', st.service, ' = ', sd.service_desc, ' ) ', st.text) AS text
FROM ({SCHEMA_TEXT.replace('SELECT t.turn_key,', 'SELECT t.turn_key, t.service,', 1)}) st
JOIN (SELECT DISTINCT service, service_desc FROM schema_slots) sd ON sd.service = st.service"""


@register("linearize_by_name", f"""
SELECT n.turn_key, n.text AS naive, p.sr AS paper, s.text AS schema, v.text AS service, t.text AS template FROM (
  SELECT turn_key, string_agg(concat(act_name, ' ', slot, ' ', array_to_string(vals, ' ')), ' <SEP> ' ORDER BY act_pos) AS text
  FROM named_acts GROUP BY turn_key) n JOIN paper_text p ON p.turn_key = n.turn_key
JOIN ({SCHEMA_TEXT}) s ON s.turn_key = n.turn_key JOIN ({SVC_TEXT}) v ON v.turn_key = n.turn_key
JOIN ({TEMPLATE_TEXT}) t ON t.turn_key = n.turn_key""")
def linearize_by_name(spark, d):
    """All five linearizers by name, on one pass over the turns."""
    t = L.with_schema(_with_templates(spark, d), fx.schema_slots(spark, d)).withColumn("intent", _intent())
    names = {"SGD_NaiveLinearizer": "naive", "SGD_PaperNaiveLinearizer": "paper", "SGD_SchemaGuidedLinearizer": "schema_text",
             "SGD_SchemaGuidedWithServiceLinearizer": "service_text", "SGD_TemplateGuidedLinearizer": "template"}
    for name, out in names.items():
        t = L.linearize_by_name(t, name, out)
    return t.select("turn_key", "naive", "paper", F.col("schema_text").alias("schema"), F.col("service_text").alias("service"), "template")


# ------------------------------------------------------------------ raw dialogues with frames

FRAME = "CASE WHEN turn_key % 5 = 0 AND act_pos >= 2 AND count(*) OVER (PARTITION BY turn_key) > 2 THEN 1 ELSE 0 END AS frame"
UPPER_FILL = FILL.replace("vals", "list_transform(vals, lambda v: upper(v))")
DIALOGUE_ROWS = f"""
WITH fr AS (SELECT *, {FRAME} FROM named_acts),
naive AS (SELECT turn_key, frame, concat('service_name=', service, ' | ', string_agg({TSV_ACT.format(s='slot')}, ' | ' ORDER BY act_pos)) AS text
  FROM fr GROUP BY turn_key, frame, service),
guided AS (SELECT turn_key, frame, concat('service_name=', service, ',description={{schema[''description'']}} | ',
    string_agg({TSV_ACT.format(s='ss')}, ' | ' ORDER BY act_pos)) AS text
  FROM (SELECT a.*, CASE WHEN s.slot IS NULL THEN a.slot ELSE {SLOT_STR} END AS ss FROM fr a
        LEFT JOIN schema_slots s ON s.service = a.service AND s.slot = a.slot) GROUP BY turn_key, frame, service),
filled AS (SELECT a.turn_key, a.frame, a.act_pos, a.act_name, {RANK} AS rnk, {UPPER_FILL} AS text
  FROM (SELECT *, {KEY} AS act_key FROM fr) a LEFT JOIN templates t ON t.service = a.service AND t.act_key = a.act_key),
t2g2 AS (SELECT turn_key, frame, concat(CASE WHEN bool_or(act_name = 'CONFIRM') THEN 'Please confirm the following details: ' ELSE '' END,
    string_agg(text, ' ' ORDER BY rnk, act_pos)) AS text FROM filled GROUP BY turn_key, frame),
texts AS (
  SELECT 'naive' AS task, turn_key, 'SYSTEM | ' || string_agg(text, ' | ' ORDER BY frame) AS input FROM naive GROUP BY turn_key
  UNION ALL SELECT 'schema_guided', turn_key, 'SYSTEM | ' || string_agg(text, ' | ' ORDER BY frame) FROM guided GROUP BY turn_key
  UNION ALL SELECT 't2g2', turn_key, 'SYSTEM | ' || string_agg(text, ' ' ORDER BY frame) FROM t2g2 GROUP BY turn_key),
ids AS (SELECT turn_key, dialog_id, target, CAST(row_number() OVER (PARTITION BY dialog_id ORDER BY turn_key) - 1 AS INTEGER) AS turn_id FROM turn_text),
n AS (SELECT turn_key, CAST(max(frame) + 1 AS INTEGER) AS n_frames, CAST(count(*) AS INTEGER) AS n_acts FROM fr GROUP BY turn_key)
SELECT x.task, i.dialog_id, i.turn_id, x.input, i.target, i.target AS meta_utterance, n.n_frames, n.n_acts
FROM texts x JOIN ids i ON i.turn_key = x.turn_key JOIN n ON n.turn_key = x.turn_key"""


@register("dialogue_task_rows", DIALOGUE_ROWS)
def dialogue_task_rows(spark, d):
    """Raw dialogue JSON -> task rows in all three representations; the metadata is parsed back."""
    from turnlens.operators.dialogue_rows import REPRESENTATIONS, task_rows_of_dialogues
    from turnlens.plans.q_files import scratch
    path = scratch(spark, "raw-dialogues")
    fx.raw_dialogues(spark, d).write.json(path, compression="gzip")
    raw = files.read_dialogues(spark, path, multi_line=False)
    out = None
    for task in REPRESENTATIONS:
        rows = task_rows_of_dialogues(raw, task, fx.schema_slots(spark, d), fx.templates(spark, d), canonical=True) \
            .withColumn("task", F.lit(task))
        out = rows if out is None else out.unionByName(rows)
    turn = F.from_json("metainfo", files.SC.RAW_TURN)
    return out.withColumn("m", turn).select(
        "task", "dialog_id", "turn_id", "input", "target", F.col("m.utterance").alias("meta_utterance"),
        F.size("m.frames").alias("n_frames"), F.aggregate("m.frames", F.lit(0), lambda n, f: n + F.size(f["actions"])).alias("n_acts"))


# ------------------------------------------------------------------ schemas of several splits

def _split_schemas(spark, d):
    """The schema of one split, and one of another split that tells region 2's services anew, without brands."""
    first = fx.schema_slots(spark, d).withColumn("schema_order", F.lit(0))
    second = first.where(F.col("service").endswith("_2") & (F.col("slot") != "brand")).withColumns({
        "schema_order": F.lit(1), "service_desc": F.concat(F.lit("Another look at "), "service"),
        "slot_desc": F.concat(F.lit("a "), F.lower("slot_desc"))})
    return first.unionByName(second)


MERGED = """merged AS (SELECT service, service_desc, slot, slot_desc, possible_values, slot_pos FROM schema_slots WHERE NOT ends_with(service, '_2')
  UNION ALL SELECT service, concat('Another look at ', service), slot, concat('a ', lower(slot_desc)), possible_values, slot_pos
  FROM schema_slots WHERE ends_with(service, '_2') AND slot <> 'brand')"""


@register("lin_split_schemas", f"""WITH {MERGED},
s3 AS ({SCHEMA_TEXT.replace('schema_slots', 'merged').replace('SELECT t.turn_key,', 'SELECT t.turn_key, t.service,', 1)}),
s7 AS (SELECT turn_key, concat('SYSTEM | service_name=', service, ',description={{schema[''description'']}} | ',
  string_agg({TSV_ACT.format(s='ss')}, ' | ' ORDER BY act_pos)) AS text
  FROM (SELECT a.*, CASE WHEN s.slot IS NULL THEN a.slot ELSE {SLOT_STR} END AS ss FROM named_acts a
        LEFT JOIN merged s ON s.service = a.service AND s.slot = a.slot) GROUP BY turn_key, service)
SELECT s3.turn_key, s3.text AS schema_text, concat('SERVICE ( ', s3.service, ' = ', m.service_desc, ' ) ', s3.text) AS service_text, s7.text AS tsv_text
FROM s3 JOIN s7 ON s7.turn_key = s3.turn_key JOIN (SELECT DISTINCT service, service_desc FROM merged) m ON m.service = s3.service""")
def lin_split_schemas(spark, d):
    """L3, L4, L7, J1 where two splits' schemas tell a service differently: the last one counts, whole."""
    schemas = _split_schemas(spark, d)
    t = L.with_schema(_turns(spark, d), schemas).join(L.slot_strings(schemas), "service", "left")
    return t.select("turn_key", L.lin_schema("dialog_acts", "slot_desc").alias("schema_text"),
                    L.lin_schema_svc("dialog_acts", "service", "service_desc", "slot_desc").alias("service_text"),
                    L.lin_tsv_schema("dialog_acts", "service_str", "slot_str").alias("tsv_text"))


@register("schema_strings_merged", f"""WITH {MERGED}
SELECT service, lower(concat('service_name=', service, ',description={{schema[''description'']}} | ', string_agg({SLOT_STR}, ' | ' ORDER BY s.slot_pos))) AS text
FROM merged s GROUP BY service""")
def schema_strings_merged(spark, d):
    """L9 of the schemas of several splits."""
    s = L.slot_strings(_split_schemas(spark, d))
    return s.select("service", L.schema_string("service_str", "slot_strs").alias("text"))
