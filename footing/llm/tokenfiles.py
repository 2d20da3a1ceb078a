"""Token files: a corpus's ids in ascending order of documents, coded by :mod:`footing.llm.idcoder`.

A folder holds

* ``frames``: rows of whole documents (file, first: ids before it in its file, n_ids, doc_ids, lengths) with their
  ids in coded blocks of at most ``block_ids``, each with checksums and readable alone.  A frame closes with the
  document that fills it, so it is bounded by its size and one document;
* ``index``: of each file the ids in the files before, written last: a folder without it is not read.

Documents move once, in a range exchange by id and an arbitrary number (so that rows of one id, or of none, are spread),
and are tokenised and coded in the task that gets them.  Spark's writers and readers do all input
and output, so any store will do, and tasks that are repeated leave no trace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footing.llm.packing import GROUP, encoder

#: Ids of a block, and ids that close a frame.
BLOCK_IDS, FRAME_IDS = 2048, 8192
#: Ids that a task codes together: a group of lanes.
FLUSH_IDS = 2048 * 2048
#: Text bytes of a file that there is no reason to cut, and that there is no reason to cut further.
FILE_BYTES, LEAST_BYTES = 1 << 30, 1 << 22
#: Files up to which the index is broadcast; beyond it is joined by exchange.
BROADCAST_FILES = 100_000

FRAMES = "file int, first long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"
DOCUMENTS = "doc_id long, file int, within long, n_tokens long, ids_crc32 long, ids binary"


def _blocks(ids: np.ndarray, block_ids: int) -> list[np.ndarray]:
    """Blocks of like length, so that coders keep step."""
    return np.array_split(ids, max(1, -(-len(ids) // block_ids)))


def _framed(docs: list, lengths: list[int], ids: np.ndarray, file: int, first: int, vocabulary: int, block_ids: int) -> pa.RecordBatch:
    """Frames of whole documents; ``ids`` are those of all, one after the other."""
    from footing.llm.idcoder import encode_blocks

    cuts, at = [0], 0
    for k, n in enumerate(lengths):
        at += n
        if at >= FRAME_IDS or k == len(lengths) - 1:
            cuts.append(k + 1)
            at = 0
    ends = np.concatenate([[0], np.cumsum(lengths)])
    parts = [_blocks(ids[ends[a] : ends[b]], block_ids) for a, b in zip(cuts, cuts[1:])]
    coded = iter(encode_blocks([p for own in parts for p in own], vocabulary))
    rows = list(zip(cuts, cuts[1:]))
    columns = [
        pa.array([file] * len(rows), pa.int32()),
        pa.array([first + int(ends[a]) for a, _ in rows], pa.int64()),
        pa.array([int(ends[b] - ends[a]) for a, b in rows], pa.int64()),
        pa.array([docs[a:b] for a, b in rows], pa.list_(pa.int64())),
        pa.array([lengths[a:b] for a, b in rows], pa.list_(pa.int64())),
        pa.array([[next(coded) for _ in own] for own in parts], pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["file", "first", "n_ids", "doc_ids", "lengths", "blocks"])


def _coder(tokenizer: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        vocabulary = max(len(encode.ends), end_id + 1)
        docs, lengths, held, pending, first, file = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, held, pending, first
            out = _framed(docs, lengths, np.frombuffer(b"".join(held), dtype="<u4"), file, first, vocabulary, block_ids)
            first += pending
            docs, lengths, held, pending = [], [], [], 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column(2)[0].as_py()
            for k in range(0, batch.num_rows, GROUP):
                some = batch.slice(k, GROUP)
                for doc, own in zip(some.column(0).to_pylist(), encode.encode(some.column(1).to_pylist())):
                    docs.append(doc)
                    lengths.append(len(own) // 4 + 1)
                    held.append(own + tail)
                    pending += lengths[-1]
                if pending >= FLUSH_IDS:
                    yield flush()
        if docs:
            yield flush()
        encode.rest()  # the reader's tasks may run in this worker next

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write all documents' ids below ``path``, in ascending order of their ids.

    A null text is empty and has its end id alone; null ids come first, rows of one id in any order;
    repeated rows are documents of their own; other columns are not looked at.  An empty table gives no frames.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(-(-size // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES), 1)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    placed = own.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    frames = placed.select("doc_id", "text", F.spark_partition_id().alias("file")).mapInArrow(_coder(tokenizer, end_id, block_ids), FRAMES)
    frames.write.option("compression", "none").parquet(f"{path}/frames")
    totals = spark.read.schema(FRAMES).parquet(f"{path}/frames").groupBy("file").agg(F.sum("n_ids").alias("n_ids")).collect()  # a row a file
    rows, before = [], 0
    for r in sorted(totals):
        rows.append((r["file"], before, r["n_ids"]))
        before += r["n_ids"]
    spark.createDataFrame(rows, "file int, before long, n_ids long").write.parquet(f"{path}/index")


def _reader(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from footing.llm.idcoder import decode_blocks
        from footing.llm.words import drop_held

        drop_held()
        names = ["doc_id", "file", "within", "n_tokens", "ids_crc32", "ids"]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = iter(decode_blocks([b for r in rows for b in r[4]]))
            out: list[list] = [[] for _ in names]
            for file, first, doc_ids, lengths, blocks in rows:
                ids, at = np.concatenate([next(found) for _ in blocks]).tobytes(), 0
                if len(ids) != 4 * sum(lengths):
                    raise ValueError("a frame's blocks do not hold its documents")
                for doc, n in zip(doc_ids, lengths):
                    own = ids[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc, file, first + at, n, zlib.crc32(own), own if keep_ids else None)):
                        column.append(value)
                    at += n
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        rows, pending = [], 0
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)) for c in ("file", "first", "doc_ids", "lengths", "blocks")]
            for k in range(batch.num_rows):
                rows.append(tuple(c[k].as_py() for c in columns))
                pending += sum(rows[-1][3])
                if pending >= FLUSH_IDS:
                    yield flush(rows)
                    rows, pending = [], 0
        if rows:
            yield flush(rows)

    return run


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit; null unless kept).

    Raises where a checksum does not hold, or the folder was not written to its end.
    """
    index = spark.read.parquet(f"{path}/index")
    small = index.count() <= BROADCAST_FILES
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames").select("file", "first", "doc_ids", "lengths", "blocks")
    docs = frames.mapInArrow(_reader(keep_ids), DOCUMENTS)
    before = index.select("file", "before")
    both = docs.join(F.broadcast(before) if small else before, "file")
    return both.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
