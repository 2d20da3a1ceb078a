from conftest import SF
from test_decontamination import nearest
from test_jaccard import brute
from test_packing import check
from test_quality import base

import corpus_pipeline
from footing.llm import common
from footing.llm import decontamination as dc
from footing.llm import toxicity


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert all(before[k] == r for k, r in kept.items()) and len(kept) == docs.count()
        seen[name] = before, kept
    before, kept = seen["quality_rules"]
    assert not any(base(r["text"])[5] for r in kept.values())
    # the method's own verdict takes few beyond the base rules
    assert len([k for k, r in before.items() if not base(r["text"])[5]]) - len(kept) <= 0.01 * len(before)
    before, kept = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k in before if labels.get(k) == 0]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)
    before, kept = seen["near_duplicates"]
    assert set(kept) == {c for _, _, c in brute([r.asDict() for r in before.values()])}
    before, kept = seen["decontamination"]
    items = [dc.bounded(dc.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, r in before.items():
        text = dc.bounded(dc.normal(r["text"]))
        if any(x in text for x in items):
            assert k not in kept
        elif k not in kept:
            assert any(nearest(x, text) <= dc.edits(x, dc.SHARE) for x in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    bins, total = check([r.asDict() for r in kept.values()], packed, 2048)
    assert bins <= -(-total // 2048) + 1


def test_run_is_its_stages_and_leaves_little(spark):
    before = common.written()
    out = corpus_pipeline.run(spark, SF)
    assert common.written() - before <= 2  # the last stage's input and its own table
    rows = out.collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= max(docs.count(), 60)
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd_docs, SF).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == [1, 2, 3, 4, 5, 6, 7, None]
    assert toxicity.Training().max_toxic == 4000
