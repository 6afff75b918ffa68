"""Explicit schemas and fixed values.

Nothing in this package infers a schema: every file source is read with one of
the ``StructType`` objects below.
"""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values the marking / generation code of
# the original research pipeline uses, or results differ.
# ---------------------------------------------------------------------------
# Act names of the fixture turns, by id. Real data brings its own table (act, act_name).
ACT_NAMES = [
    "INFORM", "REQUEST", "CONFIRM", "OFFER", "SELECT", "NOTIFY_SUCCESS",
    "INFORM_COUNT", "OFFER_INTENT", "REQ_MORE", "GOODBYE",
]
# Stable sort order of acts when rendering templates; other acts go last.
ACT_PREFERENCE_ORDER = [
    "SELECT", "INFORM_COUNT", "NOTIFY_SUCCESS", "NOTIFY_FAILURE", "INFORM", "REQUEST", "CONFIRM",
]
# Acts whose template key carries the frame intent.
INTENT_CONDITIONED_ACTS = ["NOTIFY_FAILURE", "NOTIFY_SUCCESS", "INFORM_COUNT", "OFFER_INTENT"]
# Slot values that are written literally into a template key.
LITERAL_KEY_VALUES = ["True", "False", "dontcare"]
VALUE_CHAR = "@"
KEY_SEPARATOR = "!!"
CONFIRM_PREFIX = "Please confirm the following details:"
TSV_SEPARATOR = " | "
PIPE_ESCAPE = "<vstripe>"
NAIVE_SEP = " <SEP> "
# Names of the prepared tasks and of the training sizes in their file names.
TASK_VERSIONS = ["naive", "schema_guided", "t2g2"]
TASK_SHOTS = ["5_shot", "10_shot", "20_shot", "40_shot", "80_shot", "all"]
# Slots the schema-guided linearizer keeps verbatim instead of describing.
VERBATIM_SLOTS = ["", "count", "intent"]
# End-of-text marker of the causal LM format.
END_OF_TEXT = "<|endoftext|>"
# Label id ignored by the loss.
IGNORE_LABEL = -100
# ---------------------------------------------------------------------------

ACT = T.StructType([
    T.StructField("act", T.IntegerType()),
    T.StructField("slot", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
])

TURN = T.StructType([
    T.StructField("turn_key", T.LongType()),
    T.StructField("dialog_id", T.StringType()),
    T.StructField("turn_id", T.IntegerType()),
    T.StructField("split", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("dialog_acts", T.ArrayType(ACT)),
    T.StructField("target", T.StringType()),
])

RAW_ACTION = T.StructType([
    T.StructField("act", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("canonical_values", T.ArrayType(T.StringType())),
])
RAW_FRAME = T.StructType([
    T.StructField("service", T.StringType()),
    T.StructField("actions", T.ArrayType(RAW_ACTION)),
    T.StructField("service_call", T.StructType([T.StructField("method", T.StringType())])),
])
RAW_TURN = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("utterance", T.StringType()),
    T.StructField("frames", T.ArrayType(RAW_FRAME)),
])
RAW_DIALOGUE = T.StructType([
    T.StructField("dialogue_id", T.StringType()),
    T.StructField("services", T.ArrayType(T.StringType())),
    T.StructField("turns", T.ArrayType(RAW_TURN)),
])

SCHEMA_SLOT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_categorical", T.BooleanType()),
    T.StructField("possible_values", T.ArrayType(T.StringType())),
])
SERVICE_SCHEMA = T.StructType([
    T.StructField("service_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("slots", T.ArrayType(SCHEMA_SLOT)),
])

TEMPLATE_TSV = T.StructType([
    T.StructField("act_key", T.StringType()),
    T.StructField("template", T.StringType()),
])

TASK_TSV = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("metainfo", T.StringType()),
    T.StructField("dialog_id", T.StringType()),
    T.StructField("turn_id", T.IntegerType()),
])

# Decoded rows after parsing ``N|ref | pred | input`` lines.
DECODE_ROW = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("ref", T.StringType()),
    T.StructField("pred", T.StringType()),
    T.StructField("sr", T.StringType()),
])
