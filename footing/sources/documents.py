"""Documents, pages and lines from text, tables or files.

Text is the first-class form: pages end in a form feed.  Binary formats need an external
extractor, given as a function from bytes to such text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footing.functions.text import READABLE, annotation_only, density, has_anchors, is_blank, offsets

RECORDS = (
    "identity string, spec string, source string, sha256 string, extracted_at string, page_count int, ocr_applied boolean, verified boolean, "
    "status string, checks_passed int, checks_total int, depth int, printed_total string, computed_total string, fields map<string,string>, "
    "line_items array<map<string,string>>, failures array<string>"
)
BINDINGS = "signature string, spec string, bound_at string, notes string"


def scan_folder(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Files of one folder by name: doc_id, path, content, sha256.  Suffix in lower, upper or title case."""
    cases = ",".join(dict.fromkeys((suffix.lower(), suffix.upper(), suffix.title())))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{cases}}}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("doc_id"), "path", "content", F.sha2("content", 256).alias("sha256"))


def by_name(files: DataFrame) -> DataFrame:
    """doc_id and path of scanned files, sorted by name; their contents are not moved."""
    return files.select("doc_id", "path").orderBy("doc_id", "path")


def parse_metadata(text: Column) -> Column:
    """map of "key: value" lines; parted at the first colon, the later of equal keys wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.position(F.lit(":"), x) + 1, F.length(x))).alias("value")))
    fold = lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"]))
    return F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), fold)


def extract_text(files: DataFrame, extractor: Callable[[bytes], str]) -> DataFrame:
    """doc_id, sha256, text, error of scanned files; a failing file has its error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(2):
                try:
                    texts.append(extractor(content.as_py()))
                    errors.append(None)
                except Exception as e:  # one bad file must not end the batch; its error is kept
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "sha256", "text", "error"])

    return files.select("doc_id", "sha256", "content").mapInArrow(run, "doc_id string, sha256 string, text string, error string")


def not_cached(files: DataFrame, cache: DataFrame, dpi: int = 300) -> DataFrame:
    """Files whose bytes have no entry (sha_prefix, dpi) in the cache of recognised texts."""
    return files.join(cache.where(F.col("dpi") == dpi).select(F.col("sha_prefix")), F.substring("sha256", 1, 32) == F.col("sha_prefix"), "left_anti")


def recognise(files: DataFrame, pages: Column, engine: Callable[[bytes], str], max_pages: int = 60) -> DataFrame:
    """Scanned files through a recognition engine; those of too many pages are refused with an error."""
    few = extract_text(files.where(pages <= max_pages), engine)
    many = files.where(pages > max_pages).select("doc_id", "sha256", F.lit(None).cast("string").alias("text"), F.concat(F.lit("more than "), F.lit(max_pages), F.lit(" pages")).alias("error"))
    return few.unionByName(many)


def to_pages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, page (from 1), text: parted at form feeds, without one blank last part."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\f")
    last = F.element_at(parts, -1)
    parts = F.when((F.size(parts) > 1) & (is_blank(last)), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    pages = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("page", "text"))
    return pages.withColumn("page", F.col("page") + 1)


def checked_pages(docs: DataFrame, page_counts: DataFrame, single: DataFrame, text: str = "text") -> DataFrame:
    """Pages of the documents whose parts are as many as ``page_counts`` (doc_id, page_count) says.

    Where they are not, form feeds do not tell pages apart: that document's pages come from
    ``single`` (doc_id, page, text), extracted page by page.  Documents without a count are taken as they are.
    """
    pages = to_pages(docs, text)
    parts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    off = parts.join(page_counts, "doc_id").where(F.col("n") != F.col("page_count")).select("doc_id")
    return pages.join(off, "doc_id", "left_anti").unionByName(single.join(off, "doc_id", "left_semi").select("doc_id", "page", "text"))


#: What an extractor that knows places returns beside the text of a page.
PAGE_SIZE = "struct<width:double,height:double>"
WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"


def words_in_band(words: Column, low: float, high: float) -> Column:
    """The words whose middle lies in [low, high) across the page."""
    return F.filter(words, lambda w: ((w["x0"] + w["x1"]) / 2 >= low) & ((w["x0"] + w["x1"]) / 2 < high))


def placed_words(lines: DataFrame, step: float = 6.0, height: float = 12.0) -> DataFrame:
    """doc_id, page, width, words: pages of fixed-pitch print as an extractor that knows places would give them.

    A word starts at its offset times ``step``; a line is ``height`` high.  A page is as wide as its longest line.
    """
    tokens = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    word = lambda w, at: F.struct(w.alias("text"), (at * step).alias("x0"), (F.col("line_no") * height).alias("y0"), ((at + F.length(w)) * step).alias("x1"), ((F.col("line_no") + 1) * height).alias("y1"))
    rows = lines.select("doc_id", "page", "line_no", (F.length("line") * step).alias("width"), F.zip_with(tokens, offsets(F.col("line")), word).alias("words"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "words"))), lambda r: r["words"])
    return rows.groupBy("doc_id", "page").agg(F.max("width").alias("width"), F.flatten(ordered).alias("words"))


def words_in_columns(pages: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, label, y0, text: the words of each column and line, by the place of their middles.

    ``pages``: doc_id, page, words.  ``columns``: doc_id, label, low, high, intervals [low, high) across every page of a document.
    Words and intervals meet by document; of overlapping columns a word is in each, outside all in none.
    """
    each = pages.select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*", ((F.col("w.x0") + F.col("w.x1")) / 2).alias("_middle"))
    met = each.join(columns.select("doc_id", "label", "low", "high"), "doc_id").where((F.col("_middle") >= F.col("low")) & (F.col("_middle") < F.col("high")))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    return met.groupBy("doc_id", "page", "label", "y0").agg(F.array_join(words, " ").alias("text"))


def to_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no (from 0), line.  Order is data: keep page and line_no."""
    return pages.select("doc_id", "page", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def page_density(pages: DataFrame) -> DataFrame:
    """doc_id, page, chars."""
    return pages.select("doc_id", "page", density(F.col("text")).alias("chars"))


def document_density(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, chars_per_page, needs_ocr, sparse_pages (none if the document needs recognition)."""
    by = page_density(pages).groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.avg("chars").alias("chars_per_page"),
        F.array_sort(F.collect_list(F.when(F.col("chars") < READABLE, F.col("page")))).alias("sparse"),
    )
    needs = F.col("chars_per_page") < READABLE
    return by.select("doc_id", "page_count", "chars_per_page", needs.alias("needs_ocr"), F.when(needs, F.array().cast("array<int>")).otherwise(F.col("sparse")).alias("sparse_pages"))


def unusable_reason(text: Column, chars_per_page: Column) -> Column:
    """Why a text layer cannot be parsed, NULL if it can; notes over a scan come first."""
    return (
        F.when(annotation_only(text, chars_per_page), "annotation-only text layer")
        .when(chars_per_page < READABLE, "no usable text layer")
        .when(~has_anchors(text), "no invoice vocabulary")
    )


def escalate(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """doc_id, text, reason: each document by its text layer, else by recognition, else with the reason why not.

    ``first``: doc_id, text, chars_per_page of the text layers.  ``second``: the same and error of
    recognised texts, None where recognition is not allowed.  One failing document stops no other.
    """
    why = unusable_reason(F.col("text"), F.col("chars_per_page"))
    judged = first.select("doc_id", "text", why.alias("reason"))
    if second is None:
        return judged.withColumn("reason", F.concat("reason", F.lit("; recognition was not allowed")))
    again = second.select("doc_id", F.col("text").alias("new"), F.col("error"), F.when(F.col("text").isNotNull(), why).alias("still"))
    both = judged.join(again, "doc_id", "left")
    failed = F.col("new").isNull()
    reason = (
        F.when(F.col("reason").isNull(), F.lit(None).cast("string"))
        .when(failed, F.concat("reason", F.lit("; recognition failed: "), F.coalesce("error", F.lit("not tried"))))
        .when(F.col("still").isNotNull(), F.concat("reason", F.lit("; recognition gave no usable text either")))
    )
    text = F.when(F.col("reason").isNull() | failed, F.col("text")).otherwise(F.col("new"))
    return both.select("doc_id", text.alias("text"), reason.alias("reason"))


def whole_text(lines: DataFrame) -> DataFrame:
    """doc_id, text: lines joined again in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A history of JSON lines; empty where there is none yet.

    A Spark read has no order: histories that need one are written and read by :mod:`footing.operators.commits`.
    """
    return _json(spark, path, RECORDS)


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Bindings from JSON lines, or from one JSON document that maps signatures to them under "specs"."""
    lines = _json(spark, path, BINDINGS)
    if lines.limit(1).count() == 0:
        return lines
    whole = spark.read.text(path, wholetext=True)
    held = F.from_json("value", "specs map<string, struct<spec:string, bound_at:string, notes:string>>")["specs"]
    mapped = whole.select(F.explode(held).alias("signature", "x")).select("signature", "x.*")
    return lines.where("signature is not null").unionByName(mapped)


def write_bindings(bindings: DataFrame, path: str) -> None:
    """Replace the small table of bindings; what is read from ``path`` itself must be durable first."""
    bindings.select(*[c.split()[0] for c in BINDINGS.split(", ")]).coalesce(1).write.mode("overwrite").json(path)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def known_identities(records: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """identity: distinct non-blank identities of the history and of the delivered table."""
    found = records.select(F.col("identity").cast("string"))
    if delivered is not None and "identity" in delivered.columns:
        found = found.union(delivered.select(F.col("identity").cast("string")))
    return found.where(F.trim("identity") != "").distinct()


def document_order(*partition: str) -> Window:
    return Window.partitionBy(*(partition or ("doc_id",))).orderBy("page", "line_no")
