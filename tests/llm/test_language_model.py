import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import DOCS, SF
from pyspark.sql import functions as F

from footing import tables
from footing.llm import language_model as lm
from footing.llm.common import durable, text_bytes
from footing.llm.queries import op3_lm_scoring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), b""]


def base(docs):
    counts = Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1:
            counts.update(tokens(d["text"]))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d in docs:
        own = tokens(d["text"])
        out[d["doc_id"]] = (len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = base(docs)
    rows = op3_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [0.0, 0.0, 0]
    for r in rows:
        n, known, train, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["score"] < 0
        if r["held_out"]:
            held = [held[0] + r["score"], held[1] + r["base_score"], held[2] + n]
    # on texts it has not learned from, the model is clearly better than the base
    assert held[0] / held[2] > held[1] / held[2] + 0.2


def fitted(docs):
    texts = docs.select(text_bytes("text").alias("body"))
    contexts = lm.find_contexts(texts)
    words = durable(lm.word_counts(texts, contexts), "w")
    history, mean = lm.fit_totals(words, contexts.parents)
    return durable(lm.word_probabilities(words, history, mean), "m"), mean


def test_model_sums_to_one(spark):
    """Over the vocabulary and the unseen words, in every context."""
    docs = spark.createDataFrame([(k, f"a b c{k % 3} a d e{k}") for k in range(40)], "doc_id long, text string")
    model, totals = fitted(docs)
    _, counts, logs = lm._head(model, totals, 10**6)
    assert counts.sum() == totals.tokens == 280 and len(counts) == totals.vocabulary
    rest = totals.fresh(2) * totals.fresh(1)[totals.parents] * totals.fresh(0)[0] * totals.unseen
    assert np.allclose((10**logs.astype(float)).sum(axis=0) + rest, 1, atol=1e-4)


def gibbs(n, others, parent, strength, d, sweeps, rng):
    """Tables of one dish by the direct sampler: one customer leaves and sits down again given the rest."""
    seats, out = [n], []
    for k in range(sweeps * n):
        r = rng.integers(n)
        at = int(np.searchsorted(np.cumsum(seats), r, side="right"))
        seats[at] -= 1
        if not seats[at]:
            seats.pop(at)
        weights = np.array([*(s - d for s in seats), (strength + d * (others + len(seats))) * parent if seats else 1.0])
        pick = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))
        if pick == len(seats):
            seats.append(0)
        seats[pick] += 1
        if k > 50 * n:
            out.append(len(seats))
    return np.array(out)


def test_seating_against_one_by_one():
    """The block draw has the distribution that removing and re-seating single customers converges to."""
    rng = np.random.default_rng(1)
    keys = np.arange(20_000, dtype=np.uint64)
    for n, others, parent in ((2, 3, 0.4), (7, 10, 0.2), (30, 4, 0.3)):
        full = lambda x, t=float: np.full(len(keys), x, dtype=t)
        got = lm.seat(full(n, np.int64), full(others), full(parent), 5.0, 0.6, keys, 1)
        want = gibbs(n, others, parent, 5.0, 0.6, 4000, rng)
        for t in range(1, n + 1):
            assert abs((got == t).mean() - (want == t).mean()) < 0.03, (n, t)
    for n, others, parent in ((33, 4, 0.3), (200, 4, 0.05), (200, 40, 0.5)):
        got = lm.seat(full(n, np.int64), full(others), full(parent), 5.0, 0.6, keys, 1)
        want = gibbs(n, others, parent, 5.0, 0.6, 2000, rng)
        assert abs(got.mean() - want.mean()) < 0.06 * want.mean() + 0.2, (n, got.mean(), want.mean())
        assert abs(got.std() - want.std()) < 0.2 * want.std() + 0.2


def test_partitioning_changes_no_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = {}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            rows = lm.score_documents(docs.repartition(parts), F.col("doc_id") % 5 != 1, head_words=2000).collect()
            held[parts] = {r["doc_id"]: (r["score"], r["base_score"]) for r in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert held[4] == held[7] == held[211]


def test_hot_words_count_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    rows = []
    for hot in (1e-4, 0.02, 2.0):
        monkeypatch.setattr(lm, "HOT", hot)
        texts = docs.select(text_bytes("text").alias("body"))
        rows.append(sorted(map(tuple, lm.word_counts(texts, lm.find_contexts(texts)).collect())))
    assert rows[0] == rows[1] == rows[2]


def test_head_and_rare_words_score_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    train = F.col("doc_id") % 2 == 0
    rows = [{r["doc_id"]: r for r in lm.score_documents(docs, train, head_words=h).collect()} for h in (10, 10**6)]
    for k in rows[0]:
        for c in ("n_known", "n_tokens"):
            assert rows[0][k][c] == rows[1][k][c]
        for c in ("score", "base_score"):
            assert rows[0][k][c] == pytest.approx(rows[1][k][c], rel=1e-5)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lm.score_documents(odd_docs, F.col("doc_id") != 5).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(tokens(d["text"])) for d in odd_docs.collect())
    assert lm.score_documents(no_docs, F.lit(True)).count() == 0
    none = lm.score_documents(odd_docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


def test_every_previous_word_has_a_restaurant(spark):
    """Words that end alike and are not among the OWN most frequent: what follows each is told apart, in head and rare words."""
    common = " ".join(f"c{k}" for k in range(lm.OWN))
    rows = [(k, f"{common} {common} " + " ".join(f"p{j}-end q{j}-end" for j in range(20))) for k in range(30)]
    right, wrong = "p3-end q3-end p7-end q7-end", "p3-end q7-end p7-end q3-end"
    docs = spark.createDataFrame([*rows, (100, right), (101, wrong)], "doc_id long, text string")
    for head in (0, 150, 10**6):
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 100, head_words=head).collect()}
        assert got[100] > got[101] + 2, head


def test_leaves_sum_to_one(spark):
    """Over the dishes and the parent, in the leaf of every previous word that is not among the OWN ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    texts = docs.select(text_bytes("text").alias("body"))
    contexts = lm.find_contexts(texts)
    pairs = lm.pair_counts(texts, contexts)
    room, seated = lm.leaves(pairs, 5.0)
    sums = {r["before"]: r["x"] for r in seated.groupBy("before").agg(F.sum("rho").alias("x")).collect()}
    fresh = {r["before"]: r["fresh"] for r in room.collect()}
    words = {w for d in docs.collect() for w in tokens(d["text"])[:-1]} | {lm.START}
    assert len(fresh) == len(sums) == len(words) - lm.OWN
    assert all(abs(fresh[k] * (1 + sums[k]) - 1) < 1e-9 for k in fresh)


def test_scores_against_plain_sums(spark):
    """Every token's probability, put together from the tables by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    train = F.col("doc_id") % 3 != 0
    bodies = docs.select("doc_id", text_bytes("text").alias("body"), train.alias("t"))
    learned = bodies.where("t")
    contexts = lm.find_contexts(learned)
    pairs = lm.pair_counts(learned, contexts)
    words = durable(lm.word_counts(learned, contexts, pairs), "w")
    history, mean = lm.fit_totals(words, contexts.parents)
    model = durable(lm.word_probabilities(words, history, mean), "m")
    hashes, _, logs = lm._head(model, mean, 10**7)
    room, seated = lm.leaves(pairs, lm.Sampling().strength)
    fresh = {r["before"]: r["fresh"] for r in room.collect()}
    rho = {(r["hash"], r["before"]): r["rho"] for r in seated.collect()}
    place = {h: k for k, h in enumerate(hashes.tolist())}
    index = lm.ClassedIndex(contexts)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    none = mean.fresh(2) * mean.fresh(1)[mean.parents] * mean.fresh(0)[0] * mean.unseen
    want = {}
    for d in docs.collect():
        own, total = tokens(d["text"]), 0.0
        for u, w in zip([lm.START, *own], own):
            i, j = index[u], index[w]
            code, h, c = signed(index.codes()[i]), signed(index.hashes()[j]), index.classes[i]
            p = 10.0 ** float(logs[place[h], c]) if h in place else none[c]
            total += math.log10(fresh.get(code, 1.0) * (p + rho.get((h, code), 0.0)))
        want[d["doc_id"]] = total
    for head in (50, 10**6):
        for r in lm.score_documents(docs, train, head_words=head).collect():
            assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-5)


def test_pairs_by_broadcast_and_by_join_score_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    docs = docs.unionByName(docs.limit(3))  # repeated rows each have a row
    rows = []
    for top, rounds in ((0, 1), (50, 3), (10**6, 2)):
        monkeypatch.setattr(lm, "TOP_PAIRS", top)
        monkeypatch.setattr(lm, "ROUNDS", rounds)
        rows.append(sorted((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in lm.score_documents(docs, F.col("doc_id") % 2 == 0, head_words=2000).collect()))
    assert len(rows[0]) == 303
    for other in rows[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in rows[0]]
        assert [r[3] for r in other] == pytest.approx([r[3] for r in rows[0]], rel=1e-6)


def test_little_of_a_run_stays_on_disk(spark):
    """At most the scores and the parts of the lists of words, and nothing that was shuffled for a tidy table."""
    docs = spark.createDataFrame([(k, f"a b c{k % 3} a d e{k}") for k in range(40)], "doc_id long, text string")
    first = tables.written()
    assert lm.score_documents(docs, F.lit(True)).count() == 40
    assert {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in tables._WRITTEN[first:]} <= {"scores", "word-parts"}
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {p.name for d in env.blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    durable(spark.range(1000).groupBy(F.col("id") % 7).count(), "t", tidy=True)
    end = time.time() + 20  # removal goes on behind
    while not files() <= before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before
