"""Benchmark decontamination: brute force on literal passages, re-parameterised questions, slot consistency."""

import random

import corpus_pipeline
from tests.llm.conftest import make_docs
from turnlens.llm.decontaminate import contaminated

ITEM = ("Maria bought 12 apples for 3 dollars at the market near Springfield and gave Maria half of them to her friend "
        "Peter, how many apples does Peter have after 5 days of eating one per day?")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, id string")


def found(spark, docs, items, **more):
    rows = contaminated(make_docs(spark, docs), bench(spark, [(i, t, "x") for i, t in items]), **more).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in rows)


def test_planted_passages_and_clean_documents(spark, edge_rows):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(15, 50))) for i in range(30)]
    docs, want = list(edge_rows), []
    for i in range(100, 220):
        if i % 3 == 0:
            k = r.randrange(30)
            docs.append((i, f"{text(80)}. {items[k][1].upper() if i % 2 else items[k][1]} {text(40)}"))
            want.append((i, k))
        else:
            docs.append((i, text(150)))
    assert found(spark, docs, items) == want


def test_other_numbers_names_and_units(spark):
    other = ITEM.replace("Maria", "Sofia").replace("Peter", "Hannes").replace("12", "37").replace("3 dollars", "8 euros") \
        .replace("Springfield", "Riverton").replace("5 days", "9 weeks")
    assert found(spark, [(1, "Here it is. " + other), (2, ITEM.lower()), (3, "nothing of the kind " * 20)],
                 [(7, ITEM)]) == [(1, 7), (2, 7)]


def test_inconsistent_slots_are_not_the_same_question(spark):
    item = "we asked Anna to call Anna so that Anna and Anna could see Anna when Anna met Anna near Anna today"
    names = iter(["Bert", "Cora", "Dirk", "Ella", "Finn", "Gina", "Hugo", "Ivan"])
    mixed = " ".join(next(names) if w == "Anna" else w for w in item.split())
    same = item.replace("Anna", "Greta")
    assert found(spark, [(1, mixed), (2, same)], [(5, item)], share=0.5, run=5) == [(2, 5)]


def test_item_that_a_text_holds_several_times(spark):
    def variant(n):
        return ITEM.replace("12", str(20 + n)).replace("3 dollars", f"{40 + n} dollars").replace("5 days", f"{60 + n} days") \
            .replace("Maria", "ABC"[n] + "nna").replace("Peter", "ABC"[n] + "en").replace("Springfield", "ABC"[n] + "ville")

    docs = [(1, f"{ITEM} {variant(0)} {variant(1)}"), (2, f"So. {variant(0)} And now. {variant(1)} {variant(2)}"),
            (3, variant(0)), (3, variant(1)), (None, ITEM)]
    rows = contaminated(make_docs(spark, docs), bench(spark, [(7, ITEM, "x")])).collect()
    assert sorted((r["doc_id"], r["item_id"], r["consistency"]) for r in rows) == [(i, 7, 1.0) for i in (1, 2, 3)]


def test_questions_dense_in_numbers(spark):
    items = [(1, "Order the numbers 12, 45, 7, 89, 23 and 5 from least to greatest"), (2, "What is the mean of 3 4 5 6 7 8 9 10"),
             (3, "12 13 14 15 16 of 17"), (4, "12 kg 9 m are much more than 3 kg 2 m")]
    docs = [(1, "Now. Order the numbers 31, 8, 64, 2, 90 and 17 from least to greatest"), (2, "What is the mean of 8 1 6 2 9 5 4 44 ?"),
            (3, "1 2 3 4 5 of 6"), (4, "12 13 14 15 16 of 17"), (5, "x 5 lb 4 ft are much more than 6 lb 7 ft y"),
            (6, "numbers " + "1 " * 5000 + "and 5 from least"), (7, "Sort the numbers 31, 8, 64, 2, 90 or 17 by size")]
    assert found(spark, docs, items) == [(1, 1), (2, 2), (4, 3), (5, 4)]


def test_short_null_and_repeated_items(spark):
    items = [(1, None), (2, ""), (3, "only four words here"), (4, ITEM), (5, ITEM)]
    docs = [(1, "only four words here"), (2, ITEM), (2, ITEM), (None, ITEM), (3, None)]
    assert found(spark, docs, items) == [(2, 4), (2, 5)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM)]) == []
    assert found(spark, [(1, ITEM)], []) == []


def test_pipeline_items_without_an_id(spark, tmp_path):
    bench(spark, [(None, ITEM, "x"), (1, None, "x")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(spark, [(1, ITEM), (None, ITEM), (2, "something else altogether, nothing more"), (3, None)])
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left) == [2, 3]


def test_a_phrase_that_all_items_share(spark, monkeypatch):
    """Documents with the shared opening alone meet no item; the pairs that meet grow as the true ones."""
    from turnlens.llm import decontaminate as D
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    opening = "please read the following question with care and choose one"
    items = [(i, f"{opening} {' '.join(r.choice(words) for _ in range(25))}") for i in range(120)]
    docs = [(i, f"{' '.join(r.choice(words) for _ in range(20))} {opening} {' '.join(r.choice(words) for _ in range(20))}") for i in range(400)]
    planted = [(1000 + k, f"{docs[k][1]} {items[k][1]}") for k in range(0, 40, 4)]
    sizes = []
    real = D.saved
    monkeypatch.setattr(D, "saved", lambda df: sizes.append((df.columns, real(df))) or sizes[-1][1])
    for most in (D.MOST_WINDOWS, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(D, "MOST_WINDOWS", most)
        sizes.clear()
        assert found(spark, docs + planted, items) == [(1000 + k, k) for k in range(0, 40, 4)]
        met = next(df for columns, df in sizes if "item_words" in columns)
        assert met.count() < 2000  # all pairs would be 400 x 120 x 6


def test_items_with_several_texts(spark):
    other = "Eleven farmers walked across the wooden bridge before noon while three children counted boats on the quiet river below them"
    assert found(spark, [(1, f"x {ITEM} y"), (2, other), (3, "nothing at all")], [(7, ITEM), (7, other), (8, other)]) == [(1, 7), (2, 7), (2, 8)]
