import random

import pytest
from conftest import SF

from footing.llm import decontamination as dc
from footing.llm.queries import op7_decontamination


def nearest(item, text):
    """Plain dynamic program: least distance of item to any stretch of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(new[k] + 1, row[k + 1] + 1, row[k] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        k = rng.randrange(len(t))
        how = rng.randrange(3)
        t[k : k + 1] = [["q"], [], [t[k], "z"]][how]
    return "".join(t)


@pytest.mark.parametrize("most", [1, dc.SPARE])
def test_against_plain_distance(spark, most):
    """The plain rule (k + 1 pieces, one hit) and its refinement both find every pair, at its distance and place."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [dc.normal(make(n)) for n in (12, 25, 40, 60, 90)]
    docs = []
    for k in range(60):
        item = rng.choice(items)
        docs.append((k, make(80) + " \u0130, " + edited(rng, item, rng.randrange(0, len(item) // 6 + 1)).upper() + " " + make(80)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_items(frame, bench, block_chars=100, most=most).collect()}
    want = {}
    for k, text in docs:
        for i, item in enumerate(items):
            d = nearest(dc.bounded(item), dc.bounded(dc.normal(text)))
            if d <= int(dc.SHARE * len(item)):
                want[k, i] = d
    assert {k: r["distance"] for k, r in got.items()} == want and len(want) > 20
    for (k, i), r in got.items():
        cut = docs[k][1][r["start"] : r["end"]]
        assert nearest(dc.bounded(items[i]), dc.bounded(dc.normal(cut))) == r["distance"]
        assert abs(len(dc.normal(cut)) - len(items[i])) <= 12  # whole words at its ends


def test_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "concatenate"), (2, "a cat."), (3, "the cats")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Cat")], "item_id long, text string")
    rows = dc.find_items(docs, bench).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["item_chars"]) for r in rows] == [(2, 2, 5, 3)]


def test_query_finds_exact_passages_and_little_else(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: dc.bounded(dc.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = op7_decontamination(spark, SF).collect()
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in dc.bounded(dc.normal(t))}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in rows}
    for r in rows:
        assert r["distance"] == nearest(items[r["item_id"]], dc.bounded(dc.normal(docs[r["doc_id"]][r["start"] : r["end"]])))


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "One two three"), (None, "x"), (2, None), (3, ""), (4, "?!"), (1, "a b"), (5, "é" * 40)], "item_id long, text string")
    rows = dc.find_items(odd_docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(4, 1), (4, 1), (5, 1), (6, 5)]
    assert dc.find_items(no_docs, bench).count() == 0
    assert dc.find_items(odd_docs, bench.limit(0)).count() == 0


def test_clashing_and_missing_ids(spark):
    bench = spark.createDataFrame([(1, "the first passage of one set"), (1, "another passage of a second set"), (1, "Another passage, of a second set"), (None, "a passage that has no number")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so: the first passage of one set."), (2, "so: another passage of a second set."), (3, "so: a passage that has no number."), (4, "nothing of the kind")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_items(docs, bench).collect()) == [(1, 1), (2, 1)]
    assert [r["doc_id"] for r in dc.without_items(docs, bench).collect()] == [4]
