import hashlib
from collections import defaultdict

import pytest
from conftest import DOCS
from pyspark.sql import functions as F

from footing.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fan):
    """Levels of one tree, each node a digest; the path of place p is read off them."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + fan])) for k in range(0, len(last), fan)])
    return levels


def climb(levels, place, leaf, fan):
    proof = ""
    for level in levels[:-1]:
        first = place // fan * fan
        run = level[first : first + fan]
        left, right = "".join(run[: place - first]), "".join(run[place - first + 1 :])
        proof, leaf, place = proof + left + right, sha(left + leaf + right), place // fan
    return proof, leaf


def brute(rows, fan=16):
    """(doc_id, leaf, subroot, root, siblings, folded root) of (doc_id, source, leaf, changed leaf)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = tree([r[2] for r in groups[s]], fan)
    top = tree([trees[s][-1][0] for s in sources], fan)
    out = []
    for k, s in enumerate(sources):
        for place, r in enumerate(groups[s]):
            own, sub = climb(trees[s], place, r[3] or r[2], fan)
            rest, root = climb(top, k, sub, fan)
            out.append((r[0], r[2], trees[s][-1][0], top[-1][0], own + rest, root))
    return out


def run(spark, rows, fan=16):
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, changed string")
    m = merkle.build_manifest(df, "source", ["doc_id"], F.col("leaf"), [F.col("doc_id"), F.col("changed")], fan)
    found = merkle.with_paths(m)
    got = found.select("row.doc_id", "hash", "subroot", "root", merkle.siblings(F.col("path")), merkle.folded(F.col("path"), F.coalesce("row.changed", "hash")))
    return m, sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize(("n", "sources", "fan"), [(1, 1, 16), (2, 1, 16), (16, 1, 16), (17, 1, 16), (40, 40, 16), (600, 3, 16), (300, 20, 4), (257, 2, 2)])
def test_against_brute_force(spark, n, sources, fan):
    rows = [(k, None if k % sources == 1 else f"s{'é' * (k % sources)}", sha(f"leaf {k}"), sha(f"changed {k}") if k % 5 == 0 else None) for k in range(n)]
    assert run(spark, rows, fan)[1] == sorted(brute(rows, fan), key=str)


def test_hot_group_nulls_and_repeated_rows(spark):
    """One group holds nearly all rows, ids are null or repeated, and rows are equal in all columns."""
    rows = [(None, "hot", sha("same"), None)] * 700 + [(k // 3, "hot", sha(f"x{k % 2}"), None) for k in range(300)] + [(5, None, sha("y"), sha("z"))]
    assert run(spark, rows)[1] == sorted(brute(rows), key=str)


def test_changed_leaf_is_found(spark):
    rows = [(k, "s", sha(str(k)), sha("other") if k == 7 else None) for k in range(50)]
    bad = [r[0] for r in run(spark, rows)[1] if r[5] != r[3]]
    assert bad == [7]


def test_preimages_hash_to_their_nodes(spark):
    m, _ = run(spark, [(k, f"s{k % 2}", sha(str(k)), None) for k in range(80)])
    for level in m.levels:
        assert all(sha(r["preimage"]) == r["hash"] and len(r["preimage"]) % 64 == 0 for r in level.collect())


def test_empty_table(spark):
    m, got = run(spark, [])
    assert m.root is None and got == []


def test_query_on_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.withColumns({"key": F.lit(1), "pos": F.lit("x"), "path": F.lit(2), "hash": F.lit("h")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == odd_docs.count() and len({r["root"] for r in got}) == 1
    want = sorted(sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))) for r in odd_docs.collect())
    assert sorted(r["leaf"] for r in got) == want
    # text without capitals is the same after tampering
    assert {r["doc_id"] for r in got if not r["verified"]} <= {r["doc_id"] for r in odd_docs.collect()}


def test_query_on_no_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_doc_strings_follow_the_order_of_columns(spark):
    df = spark.createDataFrame([(1, None, "é")], DOCS.split(", ")[0] + ", source string, text string")
    got = df.select(merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("text")]).alias("h")).first()["h"]
    assert got == sha("1:1-2:é")
