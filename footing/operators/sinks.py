"""Projections of verified documents and their append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.functions.money import AMOUNT


def line_items(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, page, line_no, amount and the declared fields, absent ones empty, of all charges."""
    cells = [F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")).alias(f) for f in fields]
    return rows.where("kind = 'charge'").select("doc_id", "page", "line_no", F.try_element_at("nums", F.lit("amount")).alias("amount"), *cells)


def document_facts(rows: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, page_count, printed_total, printed_subtotal, tax, departments of every document.

    The total and the tax are those of the first such row; the subtotal is what its check
    printed; departments are sorted and joined.
    """
    amount, place = F.try_element_at("nums", F.lit("amount")), F.struct("page", "line_no")
    first = lambda kind: F.min_by(F.when(F.col("kind") == kind, amount), F.when((F.col("kind") == kind) & amount.isNotNull(), place))
    dept = F.nullif(F.try_element_at("fields", F.lit("dept")), F.lit(""))
    by = rows.groupBy("doc_id").agg(
        F.max("page").cast("int").alias("page_count"), first("grand_total").alias("printed_total"), first("tax").alias("tax"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "charge", dept))), ", ").alias("departments"),
    )
    subtotal = results.where("check = 'invoice_subtotal'").groupBy("doc_id").agg(F.sum("printed").cast(AMOUNT).alias("printed_subtotal"))
    return by.join(subtotal, "doc_id", "left").select("doc_id", "page_count", "printed_total", "printed_subtotal", "tax", "departments")


def records(verdicts: DataFrame, heads: DataFrame, items: DataFrame, facts: DataFrame, spec: str) -> DataFrame:
    """One record a document in the history's schema (amounts as text, line items nested).

    ``heads``: doc_id, identity and header fields; sha256 and ocr_applied if known.
    """
    as_map = lambda columns: F.map_from_arrays(F.array(*[F.lit(c) for c in columns]).cast("array<string>"), F.array(*[F.col(c).cast("string") for c in columns]).cast("array<string>"))
    cells = as_map([c for c in items.columns if c != "doc_id"])
    nested = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", F.to_json(cells).alias("cells")))), lambda x: F.from_json(x["cells"], "map<string,string>")).alias("line_items"))
    known = [c for c in ("sha256", "ocr_applied") if c in heads.columns]
    fields = F.map_filter(as_map([c for c in heads.columns if c not in ("doc_id", "identity", *known)]), lambda k, v: v.isNotNull())
    both = verdicts.join(heads.select("doc_id", "identity", *known, fields.alias("fields")), "doc_id", "left").join(nested, "doc_id", "left").join(facts, "doc_id", "left")
    return both.select(
        F.coalesce("identity", F.lit("")).alias("identity"),
        F.lit(spec).alias("spec"),
        F.col("doc_id").cast("string").alias("source"),
        (F.col("sha256") if "sha256" in known else F.lit(None).cast("string")).alias("sha256"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"),
        "page_count",
        (F.col("ocr_applied") if "ocr_applied" in known else F.lit(False)).alias("ocr_applied"),
        "verified",
        "status",
        F.col("checks_ok").cast("int").alias("checks_passed"),
        F.col("checks_total").cast("int").alias("checks_total"),
        F.col("depth").cast("int").alias("depth"),
        F.coalesce(F.col("printed_total").cast("string"), F.lit("")).alias("printed_total"),
        F.col("computed_total").cast("string").alias("computed_total"),
        "fields",
        F.coalesce("line_items", F.array().cast("array<map<string,string>>")).alias("line_items"),
        F.col("reasons").alias("failures"),
    )


#: Columns of the fact row that are header fields of the record, by their name there.
HEADER_COLUMNS = {
    "service_ticket": "service_ticket", "customer_ref": "customer_ref", "user_id": "user_id", "sold_to": "sold_to", "payer": "payer",
    "payment_terms": "payment_terms", "sort_number": "sort_number", "route": "route",
}


def invoices(records_: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The fact row of each record, 25 columns; absent header fields are empty.  verified and flagged stand beside them."""
    field = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    more = facts.select(F.col("doc_id").cast("string").alias("source"), "printed_subtotal", "tax", "departments").join(verdicts.select(F.col("doc_id").cast("string").alias("source"), F.col("worst_delta").alias("delta")), "source", "left")
    return records_.join(more, "source", "left").select(
        F.col("identity").alias("invoice_number"),
        field("invoice_date").alias("invoice_date"),
        "status",
        F.col("page_count").alias("pages"),
        F.size("line_items").alias("line_items"),
        F.col("computed_total").try_cast(AMOUNT).alias("computed_total"),
        "printed_subtotal",
        "tax",
        F.col("printed_total").try_cast(AMOUNT).alias("printed_total"),
        "delta",
        F.format_string("%d/%d", "checks_passed", "checks_total").alias("checks"),
        "depth",
        "departments",
        *[field(k).alias(name) for name, k in HEADER_COLUMNS.items()],
        F.when(F.col("ocr_applied"), "yes").otherwise("").alias("ocr"),
        "source",
        "extracted_at",
        F.lit(None).cast("string").alias("notes"),
        "verified",
        (~F.col("verified")).alias("flagged"),
    )


#: Columns of the denormalised line item: name there -> name in the record's line items.
ITEM_COLUMNS = {
    "department": "dept", "employee": "employee", "material": "material", "description": "description", "variant": "variant", "freq": "freq", "exch": "exch",
    "qty": "quantity", "unit_price": "unit_price", "line_total": "amount", "taxable": "taxable", "page": "page",
}


def invoice_items(records_: DataFrame) -> DataFrame:
    """One row a line item with its invoice's number and date, 14 columns; fields that a layout lacks are empty."""
    each = records_.select(F.col("identity").alias("invoice_number"), F.coalesce(F.try_element_at("fields", F.lit("invoice_date")), F.lit("")).alias("invoice_date"), F.explode("line_items").alias("x"))
    cell = lambda k: F.coalesce(F.try_element_at("x", F.lit(k)), F.lit(""))
    kinds = {"line_total": AMOUNT, "page": "int"}
    return each.select("invoice_number", "invoice_date", *[(F.nullif(cell(k), F.lit("")).try_cast(kinds[name]) if name in kinds else cell(k)).alias(name) for name, k in ITEM_COLUMNS.items()])


def exception_rows(records_: DataFrame) -> DataFrame:
    """identity, source, spec, status, reason: one row a reason."""
    return records_.select("identity", "source", "spec", "status", F.explode("failures").alias("reason"))


def append(df: DataFrame, path: str, batch_id: str, form: str = "parquet") -> None:
    """Append under the batch's id; a batch that is written again replaces itself, so retries add nothing."""
    df.write.mode("overwrite").format(form).save(f"{path}/batch={batch_id}")


def run_summary(verdicts: DataFrame, results: DataFrame | None = None, recognised: int = 0) -> DataFrame:
    """n, verified, shallow (verified by one check only), recognised, advisory (mismatches that are no failures), computed_total."""
    advisory = results.where("status = 'advisory_mismatch'") if results is not None else verdicts.limit(0)
    out = verdicts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("verified").alias("verified"),
        F.count_if(F.col("verified") & (F.col("depth") == 1)).alias("shallow"),
        F.sum("computed_total").cast(AMOUNT).alias("computed_total"),
    )
    return out.crossJoin(F.broadcast(advisory.agg(F.count(F.lit(1)).alias("advisory")))).select("n", "verified", "shallow", F.lit(recognised).alias("recognised"), "advisory", "computed_total")


def sample_report(results: DataFrame) -> DataFrame:
    """check_no, check, state: the worst state of each check over its groups."""
    rank = F.when(~F.col("status").isin("pass", "not_applicable", "advisory_mismatch"), 3).when(F.col("status") == "advisory_mismatch", 2).when(F.col("status") == "pass", 1).otherwise(0)
    worst = results.groupBy("doc_id", "check_no", "check").agg(F.max(rank).alias("r"))
    return worst.select("doc_id", "check_no", "check", F.element_at(F.array(F.lit("n/a"), F.lit("PASS"), F.lit("ADVS"), F.lit("FAIL")), F.col("r") + 1).alias("state"))


def folder_status(files: DataFrame, records_: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts of files and records, and up to ``most`` flagged records."""
    counts = files.agg(F.count(F.lit(1)).alias("files")).crossJoin(records_.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("verified")).alias("flagged")))
    return counts, records_.where(~F.col("verified")).orderBy("identity").limit(most)
