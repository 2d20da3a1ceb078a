import zlib

import numpy as np
import pytest
from conftest import DOCS, SF
from pyspark.sql import functions as F

from footing.llm import idcoder, queries, tokenfiles

V = 49408


def ids(n, seed, spread=1.3):
    return (np.random.default_rng(seed).zipf(spread, n) % V).astype("<u4")


@pytest.mark.parametrize("lengths", [[0], [1], [2, 1, 0], [15, 16, 17], [2048] * 3 + [7], [300, 2048, 1, 0, 999, 300]])
def test_round_trip(lengths):
    blocks = [ids(n, k) for k, n in enumerate(lengths)]
    coded = idcoder.encode_blocks(blocks, V)
    for got, want in zip(idcoder.decode_blocks(coded), blocks):
        assert (got == want).all() and len(got) == len(want)
    # a block alone is coded and read as it is among others
    for b, c in zip(blocks, coded):
        assert idcoder.encode_blocks([b], V) == [c] and (idcoder.decode_blocks([c])[0] == b).all()


@pytest.mark.parametrize("make", [lambda n: np.zeros(n), lambda n: np.full(n, V - 1), lambda n: np.arange(n), lambda n: np.arange(n) % 7, lambda n: V - 1 - np.arange(n)])
def test_extremes(make):
    blocks = [make(n).astype("<u4") for n in (2048, 31)]
    assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(idcoder.encode_blocks(blocks, V)), blocks))


def test_large_vocabularies_and_other_block_sizes():
    for vocabulary in (2, 257, 65536, 100_000, idcoder.MOST_IDS):
        blocks = [np.random.default_rng(n).integers(0, vocabulary, n).astype("<u4") for n in (1, 500, 5000)]
        assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(idcoder.encode_blocks(blocks, vocabulary)), blocks))


@pytest.mark.parametrize("vocabulary", [0, idcoder.MOST_IDS + 1])
def test_vocabularies_out_of_bounds(vocabulary):
    with pytest.raises(ValueError):
        idcoder.encode_blocks([np.zeros(1, dtype="<u4")], vocabulary)


def test_many_lanes(monkeypatch):
    monkeypatch.setattr(idcoder, "LANES", 5)
    blocks = [ids(n, n) for n in (900, 10, 400, 400, 0, 1, 77, 901, 3, 5, 8, 13, 21)]
    assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(idcoder.encode_blocks(blocks, V)), blocks))


def test_carries_run_through_long_words(monkeypatch):
    """Many short spans: words of ones that a carry turns over come up."""
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 3, 2048).astype("<u4") * 24000 for _ in range(200)]
    assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(idcoder.encode_blocks(blocks, V)), blocks))


def test_quotients_of_floats_are_exact():
    """The coder divides whole numbers below 2**48 by floats; just below a multiple is the hardest case."""
    rng = np.random.default_rng(0)
    r, k = rng.integers(1 << 16, 1 << 32, 200_000), rng.integers(1, 1 << 16, 200_000)
    for v in (r * k - 1, r * k, r * k + 1):
        v = np.minimum(v, (1 << 48) - 1)
        assert ((v / r).astype(np.int64) == v // r).all()
    total = rng.integers(1, 1 << 29, 200_000)
    v = rng.integers(1 << 32, 1 << 48, 200_000) // total * total - 1
    assert ((v / total).astype(np.int64) == v // total).all()


def test_each_order_pays():
    """Pairs that repeat, triples that repeat and frequent ids each take fewer bits than ids at random."""
    rng = np.random.default_rng(3)
    n = 2048
    bits = lambda b: 8 * len(idcoder.encode_blocks([b.astype("<u4")], V)[0]) / n
    noise = rng.integers(0, V, n)
    follow = rng.integers(0, V, 256)
    chain = [0]
    for _ in range(n - 1):  # the next id depends on the last one alone, mostly
        chain.append(int(follow[chain[-1] % 256]) if rng.random() < 0.9 else int(rng.integers(0, V)))
    few = rng.choice([5, 900, 40_000], n, p=[0.9, 0.05, 0.05])
    assert bits(noise) < 17.5 and bits(np.asarray(chain)) < 8 and bits(few) < 1.4 and bits(np.tile(noise[:64], n // 64)) < 1.5


def test_damage_is_found():
    coded = idcoder.encode_blocks([ids(500, 1)], V)[0]
    for bad in (coded[:-1], coded[:50] + bytes([coded[50] ^ 1]) + coded[51:], coded[:4] + b"\xff" + coded[5:], coded[:12] + b"\0\0\0\0" + coded[16:], b"", b"FTB1"):
        with pytest.raises(ValueError):
            idcoder.decode_blocks([bad])


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def want(rows, order):
    """(doc_id, start, n, crc) of documents in order, each encoded alone."""
    t, at, out = tokenizer(), 0, []
    for doc, text in sorted(rows, key=order):
        own = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((doc, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    return out


def test_query_against_plain_encoding(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_files(spark, SF).collect())) == want(rows, lambda r: r[0])


@pytest.mark.parametrize("least", [1 << 22, 100])
def test_odd_rows_in_one_file_and_many(spark, odd_docs, tmp_path, monkeypatch, least):
    import public_tokenizers

    monkeypatch.setattr(tokenfiles, "LEAST_BYTES", least)
    docs = odd_docs.withColumns({"file": F.lit("clash"), "_tie": F.lit(1)})
    tokenfiles.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(spark_rows := tokenfiles.read_tokens(spark, str(tmp_path / "t"), keep_ids=True).collect(), key=lambda r: r["start"])
    exact = want([(r["doc_id"], r["text"]) for r in odd_docs.collect()], lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r)[:4] for r in got] == exact
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in spark_rows)


def test_no_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_token_files(spark, str(tmp_path)).collect() == []


def test_rows_of_one_id_are_spread(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenfiles, "LEAST_BYTES", 1000)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("some words that repeat").alias("text"))
    tokenfiles.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    sizes = [r["n_ids"] for r in spark.read.parquet(str(tmp_path / "t" / "index")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_unfinished_folder_is_not_read(spark, tmp_path):
    spark.createDataFrame([], tokenfiles.FRAMES).write.parquet(str(tmp_path / "t" / "frames"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tokenfiles.read_tokens(spark, str(tmp_path / "t")).collect()


def test_frames_hold_whole_documents(spark, tmp_path):
    import public_tokenizers

    long = spark.createDataFrame([(1, "word " * 30_000, None, None, None), (2, "a", None, None, None)], DOCS)
    tokenfiles.write_tokens(long, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    frames = spark.read.parquet(str(tmp_path / "t" / "frames")).collect()
    assert sorted(len(f["blocks"]) for f in frames) == [1, 15]
    assert max(idcoder.HEAD.unpack_from(b)[1] for f in frames for b in f["blocks"]) <= tokenfiles.BLOCK_IDS
