import random
import re

from conftest import SF

from footing.llm import licenses
from footing.llm.queries import op2_license_scan


def test_query_finds_every_notice(spark):
    rows = op2_license_scan(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, notice in licenses.TEMPLATES.items():
        want = sorted((d, m.start()) for d, t in docs.items() for m in re.finditer(re.escape(notice), t))
        got = sorted((r["doc_id"], r["start"]) for r in rows if r["license"] == name and r["coverage"] == 1.0)
        assert got == want, name
    assert {r["license"] for r in rows} >= {"MIT/notice", "Apache-2.0/notice", "GPL-3.0/notice", "CC-BY-NC-4.0/notice"}
    for r in rows:
        assert 0.8 <= r["coverage"] <= 1 and 0 <= r["start"] < r["end"] <= len(docs[r["doc_id"]])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_changed_texts_against_whole_common_subsequence(spark):
    rng = random.Random(1)
    rows = []
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        for share in (0.0, 0.05, 0.1):
            own = [w if rng.random() >= share else rng.choice(["", "other", w + " more"]) for w in words]
            rows.append((len(rows), "start of text é " + " ".join(own) + " the end", name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(docs).collect()}
    for k, text, name in rows:
        template, body = licenses.words(licenses.TEMPLATES[name].encode()), licenses.words(text.encode())
        want = lcs(template, body)
        if want >= 0.8 * len(template):
            assert abs(found[k, name]["matched_words"] - want) <= (1 if len(template) < 60 else 3)
    assert all((3 * t, name) in found for t, name in enumerate(licenses.TEMPLATES))


def test_odd_rows(spark, odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License. " * 2)], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan_licenses(twice).collect()] == ["MIT/notice"] * 2


def test_every_change_of_one_word_in_a_short_notice(spark):
    """A notice of five words or more with any one word changed, left out or another put in keeps four fifths and is found."""
    rows = []
    for name, template in licenses.TEMPLATES.items():
        own = template.split()
        if len(licenses.words(template.encode())) <= licenses.SHORT:
            for k in range(len(own)):
                for new in ([], ["other"], [own[k], "more"]):
                    text = "before it " + " ".join(own[:k] + new + own[k + 1 :]) + " after it"
                    rows.append((len(rows), text, name))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    checked = 0
    for k, text, name in rows:
        template = licenses.words(licenses.TEMPLATES[name].encode())
        if lcs(template, licenses.words(text.encode())) >= 0.8 * len(template):
            assert (k, name) in found, (name, text)
            checked += 1
    assert checked > 100


def test_index_is_winnowed_and_the_band_bounded(spark):
    built = licenses.Index(licenses.TEMPLATES)
    runs = sum(len(w) - licenses.RUN + 1 for w in built.words if len(w) > licenses.SHORT)
    assert len(licenses.TEMPLATES) >= 20 and sum(map(len, built.parts[0][3].values())) < 0.8 * runs
    # pieces of a license strewn over a long text: no alignment over the whole of it
    text = " filler ".join(licenses.TEMPLATES["MIT"].split()[k : k + 5] and " ".join(licenses.TEMPLATES["MIT"].split()[k : k + 5]) for k in range(0, 150, 5)) * 50
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() >= 1
