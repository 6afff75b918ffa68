"""Fixture views over the driver tables (see FIXTURES.md part B).

The research pipeline reads dialogue turns, service schemas, templates and
decodes.  None ship with it, so these views derive the same shapes from the
given parquet tables: an order is a system turn, its line items are dialogue
acts, a customer is a dialogue, the market segment is the service.

All views are lazy DataFrames; every join is an equi join declared with the
DataFrame API so Catalyst / AQE choose the physical strategy.  The only small
literal tables are the act enum and the per-service slot / template rows,
whose size is bounded by the number of services (<= 5 segments x 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.schemas import ACT_NAMES


def table(spark: SparkSession, d: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet table ``name`` under ``d``, pruned to ``cols`` at the scan."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def act_names(spark: SparkSession) -> DataFrame:
    """``act_names(act INT, act_name STRING)`` — the 10-value act enum."""
    return spark.createDataFrame(list(enumerate(ACT_NAMES)), "act INT, act_name STRING")


def dialog_key(col: str) -> Column:
    """``1_`` and the key, zero-padded to at least five digits (never cut)."""
    key = F.col(col).cast("string")
    return F.concat(F.lit("1_"), F.lpad(key, F.greatest(F.lit(5), F.length(key)), F.lit("0")))


def service_of(segment: str, nation: str) -> Column:
    """Service of a customer: market segment and nation modulo 3."""
    return F.concat(F.substring(segment, 1, 1), F.lower(F.expr(f"substr({segment}, 2)")), F.lit("_"),
                    (F.col(nation) % 3 + 1).cast("string"))


def split_of(orderkey: Column) -> Column:
    """Split of a turn: order key mod 10 < 8 train, = 8 validation, else test."""
    return F.when(orderkey % 10 < 8, "train").when(orderkey % 10 == 8, "validation").otherwise("test")


def _joined(spark: SparkSession, d: str, splits: list[str] | None = None) -> DataFrame:
    """Line items joined to part, order and customer, with every act column except ``act_pos``.

    Join order is chosen for scale: lineitem meets part on ``partkey`` and
    orders meet customer on ``custkey`` first, so the last join is on
    ``orderkey`` and everything grouped per turn afterwards reuses that
    partitioning.
    """
    li = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                      "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])
    pa = table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    od = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    cu = table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    if splits:
        # The split depends on the order key only: filter the orders before the
        # joins, so the filter reaches both scans of the order key.
        od = od.filter(split_of(F.col("o_orderkey")).isin(splits))
    ln = F.col("l_linenumber")

    def by_line(mapping: dict, default) -> Column:
        e = None
        for k, v in mapping.items():
            e = F.when(ln == k, v) if e is None else e.when(ln == k, v)
        return e.otherwise(default)

    # A line uses one of its part's texts: only that one goes on to the next join.
    text = by_line({1: F.col("p_name"), 2: F.col("p_brand"),
                    3: F.substring(F.col("l_shipdate").cast("string"), 1, 10),
                    5: F.lower("p_type"),
                    6: F.when(F.col("l_returnflag") == "R", "False").otherwise("True")},
                   F.lit(None).cast("string"))
    lp = li.join(pa, li.l_partkey == pa.p_partkey).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", text.alias("text"),
        F.when((ln == 1) & (F.col("l_quantity") >= 40), F.col("p_brand")).alias("value2"))
    oc = od.join(cu, od.o_custkey == cu.c_custkey)
    j = lp.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_orderkey").alias("turn_key"),
        dialog_key("o_custkey").alias("dialog_id"),
        split_of(F.col("o_orderkey")).alias("split"),
        service_of("c_mktsegment", "c_nationkey").alias("service"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        by_line({1: 4, 2: 3, 3: 0, 4: 6, 5: 2, 6: 0}, F.lit(9)).cast("int").alias("act"),
        by_line({1: "part_name", 2: "brand", 3: "ship_date", 4: "count", 5: "part_type", 6: "in_stock"},
                F.lit("")).alias("slot"),
        F.when(ln == 4, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("text")).alias("value1"),
        "value2",
        ((F.col("l_partkey") + ln) % 9 == 0).alias("dropped"),
    )


ACT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def acts(spark: SparkSession, d: str, splits: list[str] | None = None) -> DataFrame:
    """Long form, one row per dialogue act, with ``act_pos`` (order inside the turn).

    The position window is partitioned by the order key, the key of the last
    join, so it needs no further exchange.
    """
    w = Window.partitionBy("turn_key").orderBy(*ACT_ORDER)
    return _joined(spark, d, splits).withColumn("act_pos", F.row_number().over(w) - 1).drop(*ACT_ORDER)


def _turn_struct(a: DataFrame) -> DataFrame:
    slot, v1, v2 = F.col("slot"), F.col("value1"), F.col("value2")
    target_piece = (F.when(slot == "", F.lit("Goodbye and thanks."))
                    .when(v2.isNotNull(), F.concat(F.lit("The "), slot, F.lit(" is "), v1, F.lit(" and "), v2, F.lit(".")))
                    .otherwise(F.concat(F.lit("The "), slot, F.lit(" is "), v1, F.lit("."))))
    pred_piece = (F.when(slot == "", F.lit("Goodbye."))
                  .when(F.col("dropped"), F.concat(F.lit("I found a "), slot, F.lit(" for you.")))
                  .when(v2.isNotNull(), F.concat(F.lit("The "), slot, F.lit(" is "), F.upper(v1), F.lit(" and "), v2, F.lit(".")))
                  .otherwise(F.concat(F.lit("Its "), slot, F.lit(" is "), v1, F.lit("."))))
    vals = F.filter(F.array(v1, v2), lambda x: x.isNotNull())
    # Sorting the collected structs on the act-order keys gives the act
    # position without a window (and its sort) over all line items.
    g = a.groupBy("turn_key", "dialog_id", "split", "service").agg(
        F.sort_array(F.collect_list(F.struct(
            *[F.col(c) for c in ACT_ORDER], F.col("act"), slot.alias("slot"), vals.alias("values"),
            target_piece.alias("t"), pred_piece.alias("p")))).alias("xs"))
    return g


def turns(spark: SparkSession, d: str, with_pred: bool = False, splits: list[str] | None = None) -> DataFrame:
    """Nested turns: ``turn_key, dialog_id, split, service, dialog_acts, target`` (+ ``pred``).

    One aggregation builds the act array and both texts; it groups on
    ``turn_key`` (= order key), the key the act window is already partitioned
    by, so it adds no exchange.  A turn holds at most 7 acts.
    """
    g = _turn_struct(_joined(spark, d, splits))
    cols = [
        "turn_key", "dialog_id", "split", "service",
        F.transform("xs", lambda x: F.struct(x["act"].alias("act"), x["slot"].alias("slot"),
                                             x["values"].alias("values"))).alias("dialog_acts"),
        F.array_join(F.transform("xs", lambda x: x["t"]), " ").alias("target"),
    ]
    if with_pred:
        cols.append(F.array_join(F.transform("xs", lambda x: x["p"]), " ").alias("pred"))
    return g.select(*cols)


def turn_text(spark: SparkSession, d: str) -> DataFrame:
    """``turn_text(turn_key, dialog_id, split, service, target, pred)``."""
    return turns(spark, d, with_pred=True).drop("dialog_acts")


def _per_service(spark: SparkSession, d: str, rows: list[tuple], ddl: str) -> DataFrame:
    """Repeat a fixed row list for every service.

    The services are those of the customers (a dimension table, two columns):
    a schema lists its services whether or not a turn uses them, so no fact
    table is read.  Rows are generated with ``explode`` of a literal array.
    """
    names = [f.split()[0] for f in ddl.split(",")]
    lit_rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    customers = table(spark, d, "customer", ["c_mktsegment", "c_nationkey"])
    services = customers.select(service_of("c_mktsegment", "c_nationkey").alias("service")).distinct()
    return services.select("service", F.explode(lit_rows).alias("x")).select("service", "x.*")


# Fixed fixture rows (FIXTURES.md part B).
SLOT_ROWS = [
    ("part_name", "Name of the part", False, "", 0),
    ("brand", "Brand of the part", False, "", 1),
    ("ship_date", "Date of shipping", False, "", 2),
    ("part_type", "Kind of part", True, "small,medium,large", 3),
    ("in_stock", "Whether the part is in stock", True, "True,False", 4),
]
TEMPLATE_ROWS = [
    ("SELECT!!part_name!!@", "I picked the @."),
    ("SELECT!!part_name!!@@", "I picked the @ made by @."),
    ("OFFER!!brand!!@", "How about @?"),
    ("INFORM!!ship_date!!@", "It ships on @."),
    ("INFORM_COUNT!!FindParts!!count!!@", "I found @ of them."),
    ("CONFIRM!!part_type!!@", "The kind is @."),
    ("INFORM!!in_stock!!True", "It is in stock."),
    ("INFORM!!in_stock!!False", "It is out of stock."),
    ("GOODBYE", "Have a nice day."),
]
FRAME_INTENT = "FindParts"


def schema_slots(spark: SparkSession, d: str) -> DataFrame:
    """``schema_slots(service, service_desc, slot, slot_desc, is_categorical, possible_values)``."""
    s = _per_service(spark, d, SLOT_ROWS, "slot, slot_desc, is_categorical, possible_values, slot_pos")
    s = s.filter(~((F.col("service") == "Household_3") & (F.col("slot") == "brand")))
    return s.select("service",
                    F.concat(F.lit("Find and order parts, "), F.lower("service")).alias("service_desc"),
                    "slot", "slot_desc", "is_categorical", "possible_values", "slot_pos")


def templates(spark: SparkSession, d: str) -> DataFrame:
    """``templates(service, act_key, template)``."""
    return _per_service(spark, d, TEMPLATE_ROWS, "act_key, template")


def raw_turns(spark: SparkSession, d: str) -> DataFrame:
    """``raw_turns(dialog_id, pos, speaker, utterance)`` from ``conversations``."""
    c = table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(
        dialog_key("conv_id").alias("dialog_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "assistant", "SYSTEM").otherwise("USER").alias("speaker"),
        F.col("text").alias("utterance"))


def prepared_turns(spark: SparkSession, d: str) -> DataFrame:
    """``prepared_turns(dialog_id, turn_id, target)``: a re-derived corpus to diff against."""
    r = raw_turns(spark, d)
    w = Window.partitionBy("dialog_id").orderBy("pos")
    sys_turns = r.filter(F.col("speaker") == "SYSTEM").withColumn("ord", F.row_number().over(w))
    main = sys_turns.select(
        "dialog_id", F.col("ord").cast("bigint").alias("turn_id"),
        F.when(F.col("ord") == 2, F.lower("utterance")).otherwise(F.col("utterance")).alias("target"))
    extra = (r.filter(F.col("pos") == 0).select("dialog_id").distinct()
             .filter(F.col("dialog_id").endswith("0"))
             .select("dialog_id", F.lit(99).cast("bigint").alias("turn_id"), F.lit("extra").alias("target")))
    return main.unionByName(extra)


def raw_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues in the raw nested shape, one per customer: a user and a system turn for each order.

    The acts of every fifth order key are spread over two frames; canonical
    values are the values in capitals.
    """
    from turnlens.functions.columns import decode_acts
    # The turns are grouped as they are; what each becomes is built in its dialogue, so that
    # copies of its values and texts are not shuffled. A dialogue has one turn for an order and service.
    g = turns(spark, d).groupBy("dialog_id").agg(
        F.sort_array(F.collect_set("service")).alias("services"),
        F.sort_array(F.collect_list(F.struct("turn_key", "target", "service", "dialog_acts"))).alias("xs"))

    def frames(x, acts):
        call = F.struct(F.lit(FRAME_INTENT).alias("method"))
        frame = lambda xs: F.struct(x["service"].alias("service"), xs.alias("actions"), call.alias("service_call"))
        two = (x["turn_key"] % 5 == 0) & (F.size(acts) > 2)
        return F.when(two, F.array(frame(F.slice(acts, 1, 2)), frame(F.slice(acts, 3, 1000)))).otherwise(F.array(frame(acts)))

    def pair(x):
        acts = F.transform(decode_acts(x["dialog_acts"]), lambda a: F.struct(
            a["act"].alias("act"), a["slot"].alias("slot"), a["values"].alias("values"),
            F.transform(a["values"], lambda v: F.upper(v)).alias("canonical_values")))
        said = frames(x, acts)
        return F.array(F.struct(F.lit("USER").alias("speaker"), F.concat(F.lit("Show order "), x["turn_key"]).alias("utterance"),
                                F.filter(said, lambda f: F.lit(False)).alias("frames")),
                       F.struct(F.lit("SYSTEM").alias("speaker"), x["target"].alias("utterance"), said.alias("frames")))

    return g.select(F.col("dialog_id").alias("dialogue_id"), "services", F.flatten(F.transform("xs", pair)).alias("turns"))


def decodes(spark: SparkSession, d: str, sr: Column | None = None, with_acts: bool = False) -> DataFrame:
    """Decoded test rows ``(row_idx, ref, pred, sr, service)``; ``row_idx`` = ``turn_key``.

    ``sr`` (the model input text) defaults to the paper-naive linearization.
    ``with_acts`` also keeps the turn's ``dialog_acts`` (the test-set record the
    decode line belongs to), which saves the J2 self-join when decodes and
    turns come from the same fixture.
    """
    from turnlens.operators.linearize import lin_paper
    from turnlens.functions.columns import decode_acts
    t = turns(spark, d, with_pred=True, splits=["test"])
    extra = ["dialog_acts"] if with_acts else []
    return t.select(F.col("turn_key").alias("row_idx"), F.col("target").alias("ref"), "pred",
                    (sr if sr is not None else lin_paper(decode_acts("dialog_acts"))).alias("sr"), "service", *extra)


def decodes_second_run(spark: SparkSession, d: str, with_acts: bool = False) -> DataFrame:
    """A second run for comparisons: ``pred = ref`` where ``row_idx % 3 = 0``."""
    dec = decodes(spark, d, with_acts=with_acts)
    return dec.withColumn("pred", F.when(F.col("row_idx") % 3 == 0, F.col("ref")).otherwise(F.col("pred")))
