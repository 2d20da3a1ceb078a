import itertools
import math
import zlib

import pytest
from conftest import SF

from footing.llm import toxicity
from footing.llm.queries import op9_toxicity


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(a == b for a, b, _ in test) / len(test)
    found = sum(a and b for a, b, _ in test) / sum(a for a, _, _ in test)
    wrong = sum(b and not a for a, b, _ in test)
    assert right >= 0.97 and found >= 0.85 and wrong <= 0.015 * len(test), (right, found, wrong)


@pytest.fixture(scope="module")
def decoder(spark):
    return toxicity.Decoder(toxicity.character_model(toxicity.character_counts(spark.read.parquet(f"{SF}/documents.parquet"))).tolist())


def test_restores_obfuscated_words(decoder):
    for written in ("1d1ot", "id!ot", "i.d.i.o.t", "idiiiiot", "i-d-1-0-t", "m0ron", "tr@sh", "$cum", "l0$er"):
        plain = {"1d1ot": "idiot", "id!ot": "idiot", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "i-d-1-0-t": "idiot", "m0ron": "moron", "tr@sh": "trash", "$cum": "scum", "l0$er": "loser"}[written]
        assert plain in decoder.readings(written), (written, decoder.readings(written))
    assert "idiot" in decoder.spaced("you i d i o t there".split())
    assert decoder.readings("plain,") == ["plain"]


def test_viterbi_against_all_paths(decoder):
    for word in ("1d!0t", "aab", "4$$", "x.y", "!1|"):
        paths = {}
        for path in itertools.product(*decoder.options(word)):
            text = "".join(x for x, _ in path)
            a = b = 0
            score = sum(c for _, c in path)
            for x in [*map(toxicity._class, text), 0]:
                score += decoder.model[a][b][x]
                a, b = b, x
            paths[text] = max(paths.get(text, -math.inf), score)
        assert paths[decoder.restore(word)] == pytest.approx(max(paths.values()))


def test_obfuscated_text_scores_like_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scorer = toxicity.fit_toxicity(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    for text in ("what an idiot he is", "what an 1d10t he is", "what an i d i o t he is", "such a l.o.s.e.r", "scuuuum of the"):
        assert scorer.score(text) >= 0.5, text
    for text in ("", "the and of", "call 555-1234 or mail a@b.org", "scunthorpe"):
        assert scorer.score(text) < 0.5, text


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (99, 1), (5, None)], "doc_id long, toxic int")
    scorer = toxicity.fit_toxicity(odd_docs, labels)
    rows = toxicity.score_toxicity(odd_docs, scorer).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(no_docs, toxicity.fit_toxicity(no_docs, labels.limit(0))).count() == 0


def test_every_word_of_a_spelled_out_text_is_scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scorer = toxicity.fit_toxicity(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))

    def spell(text, sign=" "):
        return sign.join(text.replace(" ", ""))

    long = "go home now and leave us all alone here because " * 2 + "you are an idiot"
    bad = ["such a l o s e r", spell("idiot stupid"), spell(long), spell(long, "."), "idi" + "o" * 65 + "t", "he is an i d i o t, really", "he is an i. d. i. o. t.", "an idiott"]
    for text in bad:
        assert scorer.score(text) >= 0.5, text
    for text in (spell("the class assessment of this year"), spell("the weather is nice today", "."), "1 2 3 4 5 6 " * 40, "a = b + c", "what? (see end!"):
        assert scorer.score(text) < 0.5, text
    assert "idiot" in scorer.decoder.readings("|diot.")
    assert len(scorer.decoder.parted("idiot" * 20_000)) >= 20_000


#: Ways to write a word, and a share of the planted texts for each.
LEET = str.maketrans("aeiost", "4310$7")
WAYS = {
    "plain": lambda w: w,
    "look-alikes": lambda w: w.translate(LEET),
    "dots": ".".join,
    "spaces": " ".join,
    "repeats": lambda w: w[:2] + w[2] * 4 + w[3:],
    "look-alikes and dashes": lambda w: "-".join(w.translate(LEET)),
    "look-alikes and spaces": lambda w: " ".join(w.translate(LEET)),
    "two words in one run": lambda w: " ".join("you" + w),
}


class Undecoded(toxicity.Decoder):
    """No channel: the letters of a chunk as they stand."""

    def readings(self, chunk):
        return toxicity._LETTERS.findall(chunk)

    def spaced(self, chunks):
        return []


def test_recall_of_planted_obfuscation(spark):
    """Clean texts with one insult planted in each, written in eight ways; with the decoder and without."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorer = toxicity.fit_toxicity(docs, labels)
    insults = ["idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown"]
    ids = labels.where("toxic = 0").orderBy("doc_id").limit(240)
    texts = [r["text"] for r in docs.join(ids, "doc_id").orderBy("doc_id").collect() if r["text"]]
    clean = [t for t in texts if scorer.score(t) < 0.5]
    assert len(clean) >= 0.97 * len(texts)
    plain = toxicity.Scorer(Undecoded(scorer.decoder.model), scorer.weights, scorer.nothing)
    recall = {}
    for way, write in WAYS.items():
        hits = [0, 0]
        for k, text in enumerate(clean):
            words = text.split()
            at = k % (len(words) + 1)
            planted = " ".join([*words[:at], write(insults[k % len(insults)]), *words[at:]])
            hits[0] += scorer.score(planted) >= 0.5
            hits[1] += plain.score(planted) >= 0.5
        recall[way] = (round(hits[0] / len(clean), 3), round(hits[1] / len(clean), 3))
    print(recall)
    assert recall["plain"][0] >= 0.99 and recall["plain"][1] >= 0.99
    for way, (restored, written) in recall.items():
        assert restored >= 0.85, recall
        if way != "plain":
            assert written <= 0.1, recall


def test_labels_without_a_document_do_not_count(spark):
    """Counts are of labelled rows that have a document: others change no score."""
    docs = spark.createDataFrame([(k, "you awful thing" if k % 4 == 0 else f"a fine day {k}") for k in range(200)], "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(200)]
    more = [(k, 1) for k in range(1000, 1400)] + [(k, 0) for k in range(2000, 2100)]
    scores = []
    for rows in (labels, labels + more):
        scorer = toxicity.fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        scores.append([scorer.score(t) for t in ("you awful thing", "a fine day", "")] + [scorer.weights])
    assert scores[0] == scores[1]
