import zlib

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from conftest import SF
from tokenizers import Tokenizer

from footing.llm import packing
from footing.llm.queries import op1_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for d in docs:
        ids = np.asarray([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), capacity):
            key = (d["doc_id"], k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    places = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(k[3] * n for k, n in want.items())


def test_query_against_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bins, total = check(docs, op1_best_fit_packing(spark, SF).collect(), 2048)
    assert bins <= -(-total // 2048) + 1


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs.collect(), packing.pack_documents(odd_docs, PATH, capacity=64, rounds=40).collect(), 64)
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_plan_covers_every_rank_once():
    rng = np.random.default_rng(3)
    for capacity, bins in ((10, 400), (97, 3000), (2048, 500)):
        lengths = rng.integers(1, capacity + 1, bins)
        histogram = dict(zip(*np.unique(lengths, return_counts=True)))
        seen = {int(k): [] for k in histogram}
        for length, lo, hi, per, first, offset in packing.plan_bins(histogram, capacity, 60):
            seen[length] += range(lo, hi)
        assert {k: sorted(v) for k, v in seen.items()} == {int(k): list(range(n)) for k, n in histogram.items()}


def sequences(rows):
    return max((first + (hi - lo) // per for _, lo, hi, per, first, _ in rows), default=0)


def test_program_beats_greedy_where_they_differ():
    # pairs of 6 + 4 fill bins of 10; a fullest-first greedy choice of 5s alone would not
    assert sequences(packing.plan_bins({6: 100, 4: 100, 5: 100}, 10)) == 150


def shuffled_lengths(spark):
    pieces = packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet"), PATH, 2048)
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def test_program_against_best_fit_and_the_bound(spark):
    """At every size the program places all but a few sequences, no more than plain best fit and near the bound."""
    own = shuffled_lengths(spark)
    for times in (1, 40):
        histogram = {k: n * times for k, n in own.items()}
        bins = sequences(packing.plan_bins(histogram, 2048))
        bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
        assert bins <= sum(n for _, n in packing.best_fit(histogram, 2048))
        assert bins <= bound * 1.001 + 1
    # lengths over a third of the capacity: here the bound is not the sum of the lengths
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(35, 100, 20_000), return_counts=True))}
    live = np.asarray(sorted(histogram))
    counts = np.asarray([histogram[k] for k in live])
    bound = (packing.solve_program(live, counts, 100, 40)[1] * counts).sum()
    bins = sequences(packing.plan_bins(histogram, 100))
    assert bound <= bins <= sum(n for _, n in packing.best_fit(histogram, 100))


def plain_best_fit(histogram, capacity):
    """Piece by piece, the longest first, into the fullest sequence that takes it."""
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect_left(rooms, length)
            room = rooms.pop(k) if k < len(rooms) else capacity
            n += room == capacity
            insort(rooms, room - length)
    return n


HISTOGRAMS = {
    "uniform, few": lambda rng: rng.integers(1, 2049, 2000), "uniform, many": lambda rng: rng.integers(1, 2049, 20_000), "six lengths": lambda rng: rng.choice([1367, 1025, 684, 683, 342, 341], 10_000),
    "middling": lambda rng: rng.integers(500, 1101, 5000), "log-normal": lambda rng: np.clip(rng.lognormal(6.5, 1, 10_000), 1, 2048).astype(int), "one length": lambda rng: np.full(5000, 700), "tiny": lambda rng: rng.integers(1, 2049, 3),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_never_more_than_best_fit(name):
    histogram = dict(Counter(HISTOGRAMS[name](np.random.default_rng(7)).tolist()))
    want = plain_best_fit(histogram, 2048)
    assert sum(n for _, n in packing.best_fit(histogram, 2048)) == want
    assert -(-sum(k * n for k, n in histogram.items()) // 2048) <= sequences(packing.plan_bins(histogram, 2048)) <= want


def test_counts_of_a_large_corpus_take_no_longer():
    """A hundred million pieces a length: the plan's size depends on the lengths alone."""
    histogram = {int(k): 100_000_000 for k in np.random.default_rng(2).integers(1, 2049, 300)}
    rows = packing.plan_bins(histogram, 2048)
    assert len(rows) < 50_000 and sequences(rows) >= sum(k * n for k, n in histogram.items()) // 2048


def test_only_little_is_left_to_best_fit(spark, monkeypatch):
    left = {}
    monkeypatch.setattr(packing, "best_fit", lambda rest, capacity: left.update(rest) or [])
    histogram = shuffled_lengths(spark)
    packing.plan_bins(histogram, 2048)
    assert sum(k * n for k, n in left.items()) <= 4 * 2048


def test_columns_of_the_caller_stay(spark):
    pieces = spark.createDataFrame([(k, 0, 7, 1, k, k, k, k, k) for k in range(20)], "doc_id long, piece int, length long, ids_crc32 long, bucket long, within long, before long, rank long, plan long")
    rows = packing.pack_pieces(pieces, 21).collect()
    assert all(r["bucket"] == r["within"] == r["before"] == r["rank"] == r["plan"] == r["doc_id"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == 7


def test_worker_keeps_little_after_a_task(monkeypatch):
    """What a task has learned is let go at its end where it is much, so that idle workers hold little."""
    import pyarrow as pa

    from footing.llm import words

    monkeypatch.setattr(words, "_HELD", {})
    monkeypatch.setattr(packing, "KEPT_WORDS", 5000)
    texts = [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(70)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(70), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = packing._cutter(PATH, 2048, 0, False)
    first, few = (next(run(iter([b]))) for b in (batch, batch.slice(0, 1)))
    for k, b in enumerate((batch.slice(0, 1), batch)):
        out = list(run(iter([b])))
        assert out[0] == (few if k == 0 else first)
    (held,) = words._HELD.values()
    assert len(held.words) <= packing.KEPT_WORDS and len(held.pieces) <= packing.KEPT_WORDS


def test_tasks_give_back_at_their_end(monkeypatch):
    from footing.llm import words

    seen = []
    monkeypatch.setattr(words, "give_back", lambda: seen.append(True))
    batches = words.resting(lambda own: (2 * x for x in own))(iter([1, 2]))
    assert next(batches) == 2 and not seen
    assert list(batches) == [4] and seen == [True]
