"""The BLEU queries by domain and over all: no step of them makes more rows than the line items they read."""

import datetime

import pytest

import __spark_entry__ as E
from tests import refimpl

KEYS = ["bleu_by_domain", "domain_metrics", "domain_pivot", "domain_union", "bleu_corpus"]
ORDERS, LINES = 40, 7


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    customers = [(i, segments[i % 5], i % 7) for i in range(10)]
    parts = [(i, f"navy lace part {i}", f"Brand#{i % 5}", "SMALL PLATED TIN") for i in range(9)]
    orders = [(10 * i + 9, i % 10) for i in range(ORDERS)]
    day = datetime.date(1995, 3, 1)
    lines = [(10 * i + 9, (i + n) % 9, 1, n, 35.0 + n, 100.0 + i, "RAN"[n % 3], day + datetime.timedelta(days=i)) for i in range(ORDERS) for n in range(1, LINES + 1)]
    for name, rows, ddl in (
            ("customer", customers, "c_custkey long, c_mktsegment string, c_nationkey int"),
            ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string"),
            ("orders", orders, "o_orderkey long, o_custkey long"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_returnflag string, l_shipdate date")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def rows_made(node) -> list[tuple[int, str]]:
    """``(output rows, name)`` of every step of a plan that has run."""
    name, under = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        under.append(node.executedPlan())
    elif name.endswith("QueryStage"):
        under.append(node.plan())
    else:
        under += [node.children().apply(i) for i in range(node.children().size())]
    made = node.metrics().get("numOutputRows")
    return ([(made.get().value(), name)] if made.isDefined() else []) + [x for n in under for x in rows_made(n)]


@pytest.mark.parametrize("key", KEYS)
def test_no_step_makes_more_rows_than_line_items(spark, tables, key):
    df = E.queries()[key](spark, tables)
    assert df.collect()
    made = rows_made(df._jdf.queryExecution().executedPlan())
    assert max(made)[0] == ORDERS * LINES, sorted(made)[-5:]


def test_scores_agree_with_plain_python(spark, tables):
    from turnlens.sources import fixtures as fx
    rows = [(r["service"].split("_")[0], r["ref"], r["pred"]) for r in fx.decodes(spark, tables).collect()]
    assert len(rows) == ORDERS
    got = {r["domain"]: r["bleu"] for r in E.queries()["bleu_by_domain"](spark, tables).collect()}
    want = {x: refimpl.corpus_bleu([r for y, r, _ in rows if y == x], [p for y, _, p in rows if y == x]) for x, _, _ in rows}
    assert got == pytest.approx(want, abs=1e-6) and len(got) == 5
    all_rows = refimpl.corpus_bleu([r for _, r, _ in rows], [p for _, _, p in rows])
    assert E.queries()["bleu_corpus"](spark, tables).collect()[0]["bleu"] == pytest.approx(all_rows, abs=1e-6)
