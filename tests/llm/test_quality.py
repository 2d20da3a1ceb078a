import random
import re

import numpy as np
from conftest import SF

from footing.llm import quality
from footing.llm.queries import op8_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    hit = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def brute_longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_query_base_columns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[1:7]) == base(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_suffix_array_against_all_pairs():
    rng = random.Random(2)
    docs = [[rng.randrange(k) for _ in range(rng.randrange(60))] for k in (1, 2, 3, 5, 9, 30) for _ in range(12)]
    docs.append([1, 2, 3, 4] * 20)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = quality.suffix_repeats(doc, np.array([w for d in docs for w in d], dtype=np.int64)).tolist()
    assert got == [x for d in docs for x in brute_longest(d)]
    covered = quality.united(doc, np.array(got), 4).tolist()
    want = []
    for d in docs:
        flags = [False] * len(d)
        for i, k in enumerate(brute_longest(d)):
            if k >= 4:
                flags[i : i + k] = [True] * k
        want += flags
    assert covered == want


def test_verdict(spark):
    words = [f"w{k}" for k in range(400)]
    block = " ".join(words[:120])
    rows = [(1, " ".join(words)), (2, " ".join(words) + " " + block), (3, " ".join(words[:49])), (4, block + " " + block)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.measure_quality(docs).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[2]["longest_run"] == 120 and got[2]["covered_words"] == 240


def test_odd_rows(spark, odd_docs, no_docs):
    rows = quality.measure_quality(odd_docs).collect()
    want = sorted((base(d["text"]) for d in odd_docs.collect()))
    assert sorted(tuple(r[1:7]) for r in rows) == want
    assert quality.measure_quality(no_docs).count() == 0
