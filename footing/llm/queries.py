"""Contract queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footing.llm import chat, decontamination, html, jaccard, language_model, licenses, merkle, packing, quality, sharding, tokenfiles, toxicity, yinyang
from footing.llm import pipeline as stages
from footing.llm.common import durable, fold, shared_dir, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id")
    scored = language_model.score_documents(table(spark, sf_dir, "documents"), part != 1)
    return scored.select("doc_id", (part == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.format_windows(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, scorer)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfiles.read_tokens(spark, path).drop("ids")


def op12_yinyang_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = durable(yinyang.integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return yinyang.with_totals(yinyang.cluster_vectors(vectors, yinyang.first_by_hash(vectors), rounds=3))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold("doc_id") == 0, fields(lowered)).alias("tampered")
    manifest = merkle.build_manifest(docs, "source", ["doc_id"], fields(F.col("text")), [F.col("doc_id"), tampered])
    found = merkle.with_paths(manifest).select("row.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", "row.tampered")
    proof = merkle.digest(merkle.siblings(F.col("path")))
    back = found.withColumns({"proof_sha256": proof, "folded_root": merkle.folded(F.col("path"), F.coalesce("tampered", "leaf"))})
    return back.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_license_scan,
        op3_lm_scoring,
        op4_sharding,
        op5_html_extraction,
        op6_chat_formatting,
        op7_decontamination,
        op8_quality_rules,
        op9_toxicity,
        op10_jaccard_join,
        op11_token_files,
        op12_yinyang_clustering,
        op13_merkle_manifest,
        pipeline,
    )
}

# One assignment of every vector to its nearest centroid, and the centroids' move, in SQL.
_ASSIGN = """
a{0} AS MATERIALIZED (SELECT vec_id, v, arg_min({{'num': num, 'd': d}}, (d, num)) AS b
  FROM (SELECT k.vec_id, k.v, m.num, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT AS d FROM kept k, c{0} m) GROUP BY vec_id, v)"""
_MOVE = """
c{1} AS MATERIALIZED (SELECT o.num, coalesce(m.v, o.v) AS v FROM c{0} o LEFT JOIN (
  SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
    SELECT b.num AS num, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY b.num, i) GROUP BY num) m ON m.num = o.num)"""

# The other operators rest on a tokenizer, hashes, a trained model or an alignment, which SQL
# does not have; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.sh) + len(q.sh) - n)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, t.b FROM r JOIN t ON r.m = t.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(m) FROM r WHERE d = doc_id) AS component_id FROM s
""",
    "op12_yinyang_clustering": rf"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS num, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16)),
{"".join(f"{_ASSIGN.format(k)},{_MOVE.format(k, k + 1)}," for k in range(3))}{_ASSIGN.format(3)}
SELECT a.vec_id, CAST(a.b.num AS INTEGER) AS cluster, a.b.d AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.num) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 ON c3.num = a.b.num
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE
crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
docs AS MATERIALIZED (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c % 256, b) AS INTEGER) + 1])), 4294967295) % 5 = 0 AS touched
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, source, touched, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT source, max(lvl) + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, pos // 16),
roots AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM roots
  UNION ALL
  SELECT max(lvl) + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 16),
kids AS MATERIALIZED (SELECT source, lvl, pos // 16 AS up, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 16),
topkids AS MATERIALIZED (SELECT lvl, pos // 16 AS up, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
climb(doc_id, source, lvl, pos, n, h, proof) AS (
  SELECT doc_id, source, 0, pos, n, CASE WHEN touched THEN changed ELSE leaf END, '' FROM placed
  UNION ALL
  SELECT c.doc_id, c.source, c.lvl + 1, c.pos // 16, (c.n + 15) // 16,
    sha256(array_to_string(k.hs[1:c.pos % 16], '') || c.h || array_to_string(k.hs[c.pos % 16 + 2:], '')),
    c.proof || array_to_string(k.hs[1:c.pos % 16], '') || array_to_string(k.hs[c.pos % 16 + 2:], '')
  FROM climb c JOIN kids k ON k.source IS NOT DISTINCT FROM c.source AND k.lvl = c.lvl AND k.up = c.pos // 16 WHERE c.n > 1),
mid AS MATERIALIZED (SELECT c.doc_id, c.source, r.pos, r.n, c.h, c.proof, r.h AS subroot FROM climb c JOIN roots r ON r.source IS NOT DISTINCT FROM c.source WHERE c.n = 1),
ascend(doc_id, lvl, pos, n, h, proof, subroot) AS (
  SELECT doc_id, 0, pos, n, h, proof, subroot FROM mid
  UNION ALL
  SELECT c.doc_id, c.lvl + 1, c.pos // 16, (c.n + 15) // 16,
    sha256(array_to_string(k.hs[1:c.pos % 16], '') || c.h || array_to_string(k.hs[c.pos % 16 + 2:], '')),
    c.proof || array_to_string(k.hs[1:c.pos % 16], '') || array_to_string(k.hs[c.pos % 16 + 2:], ''), c.subroot
  FROM ascend c JOIN topkids k ON k.lvl = c.lvl AND k.up = c.pos // 16 WHERE c.n > 1),
whole AS (SELECT h AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, a.subroot, w.root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = w.root AS verified
FROM ascend a JOIN placed p USING (doc_id), whole w WHERE a.n = 1
""",
}
