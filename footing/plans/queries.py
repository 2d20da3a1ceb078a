"""Contract queries of the engine and the SQL that checks them, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footing.functions import money as M
from footing.functions import text as T
from footing.operators import commits, discover, folds, ladder, profiles, rules, scans, sinks, state
from footing.plans import dispatch, invoices, layouts, printed
from footing.shipping import ship
from footing.sources import documents as D
from footing.tables import discard, durable, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AMOUNT = M.AMOUNT


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row(kind, doc, ord_, amount, *, field: str = "amount", group=None) -> list:
    """Columns of a classified row made from a table."""
    grp = F.create_map(F.lit("group"), group) if group is not None else F.expr("cast(map() as map<string,string>)")
    return [doc.alias("doc_id"), F.lit(1).alias("page"), ord_.cast("long").alias("line_no"), F.lit(kind).alias("kind"), F.lit("").alias("raw"), F.lit("body").alias("zone"), grp.alias("fields"), F.create_map(F.lit(field), amount.cast(AMOUNT)).alias("nums"), F.lit(False).alias("row_error")]


# ---- reconciliation


@query("""
WITH c AS (SELECT l_orderkey k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) s FROM lineitem GROUP BY 1),
     p AS (SELECT o_orderkey k, CAST(o_totalprice AS DECIMAL(18,2)) s FROM orders)
SELECT CAST(coalesce(c.k, p.k) AS BIGINT) AS doc_id,
       CASE WHEN p.k IS NULL THEN 'missing_printed' WHEN c.k IS NULL THEN 'orphan_printed' WHEN c.s = p.s THEN 'pass' ELSE 'fail' END AS status,
       CAST(CASE WHEN c.k IS NULL THEN 0 ELSE c.s END AS DECIMAL(18,2)) AS computed, CAST(p.s AS DECIMAL(18,2)) AS printed,
       CAST(CASE WHEN p.k IS NULL THEN NULL ELSE coalesce(c.s, 0) - p.s END AS DECIMAL(18,2)) AS delta
FROM c FULL OUTER JOIN p ON c.k = p.k
""")
def rung_sum_by_order(spark, sf_dir):
    charges = table(spark, sf_dir, "lineitem").select(*_row("charge", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")))
    totals = table(spark, sf_dir, "orders").select(*_row("grand_total", F.col("o_orderkey"), F.lit(0), F.col("o_totalprice")))
    out = ladder.reconcile(charges.unionByName(totals), [ladder.Check("total", ("charge",), "grand_total")])
    return out.select("doc_id", "status", "computed", "printed", "delta")


@query("""
WITH c AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1),
     p AS (SELECT c_custkey k, CAST(c_nationkey AS DECIMAL(18,2)) n FROM customer)
SELECT CAST(coalesce(c.k, p.k) AS BIGINT) AS doc_id,
       CASE WHEN p.k IS NULL THEN 'missing_printed' WHEN c.k IS NULL THEN 'orphan_printed' WHEN c.n = p.n THEN 'pass' ELSE 'fail' END AS status,
       CAST(coalesce(c.n, 0) AS DECIMAL(18,2)) AS computed, CAST(p.n AS DECIMAL(18,2)) AS printed
FROM c FULL OUTER JOIN p ON c.k = p.k
""")
def rung_count_by_customer(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(*_row("charge", F.col("o_custkey"), F.col("o_orderkey"), F.lit(0)))
    printed = table(spark, sf_dir, "customer").select(*_row("row_count", F.col("c_custkey"), F.lit(0), F.col("c_nationkey"), field="count"))
    out = ladder.reconcile(items.unionByName(printed), [ladder.Check("rows", ("charge",), "row_count", printed_field="count", mode="count")])
    return out.select("doc_id", "status", "computed", "printed")


def _arms(spark, sf_dir) -> DataFrame:
    """Charges by supplier and flag; printed sums right, wrong, missing or without charges."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_extendedprice").cast(AMOUNT).alias("v"), F.monotonically_increasing_id().alias("o"))
    charges = items.select(*_row("charge", F.col("s"), F.col("o"), F.col("v"), group=F.col("g")))
    sums = items.groupBy("s", "g").agg(F.sum("v").cast(AMOUNT).alias("v"))
    sums = sums.where(~((F.col("s") % 5 == 0) & (F.col("g") == "AF"))).withColumn("v", F.when(F.col("s") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    orphans = items.select("s").distinct().where("s % 11 = 0").select("s", F.lit("ZZ").alias("g"), F.lit(1).cast(AMOUNT).alias("v"))
    printed = sums.unionByName(orphans).where("s % 13 <> 0")
    return charges.unionByName(printed.select(*_row("group_subtotal", F.col("s"), F.lit(-1), F.col("v"), group=F.col("g"))))


_ARMS_SQL = """
WITH i AS (SELECT l_suppkey s, l_returnflag || l_linestatus g, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem),
     c AS (SELECT s, g, sum(v) v FROM i GROUP BY 1, 2),
     p AS (SELECT s, g, CASE WHEN s % 7 = 0 THEN v + 1 ELSE v END v FROM c WHERE NOT (s % 5 = 0 AND g = 'AF') AND s % 13 <> 0
           UNION ALL SELECT DISTINCT s, 'ZZ', 1 FROM i WHERE s % 11 = 0 AND s % 13 <> 0),
     r AS (SELECT coalesce(c.s, p.s) s, coalesce(c.g, p.g) g,
                  CASE WHEN p.s IS NULL THEN 'missing_printed' WHEN c.s IS NULL THEN 'orphan_printed' WHEN c.v = p.v THEN 'pass' ELSE 'fail' END status,
                  coalesce(c.v, 0) computed, p.v printed
           FROM c FULL OUTER JOIN p ON c.s = p.s AND c.g = p.g WHERE coalesce(c.s, p.s) % 13 <> 0
           UNION ALL SELECT s, NULL, 'missing_printed', sum(v), NULL FROM c WHERE s % 13 = 0 GROUP BY s)
"""
_ARM_CHECKS = [ladder.Check("by_flag", ("charge",), "group_subtotal", group_by="group"), ladder.Check("grand", ("charge",), "grand_total", required=False)]


@query(_ARMS_SQL + "SELECT CAST(s AS BIGINT) AS doc_id, g AS grp, status, CAST(computed AS DECIMAL(18,2)) AS computed, CAST(printed AS DECIMAL(18,2)) AS printed FROM r")
def rung_all_arms(spark, sf_dir):
    return ladder.reconcile(_arms(spark, sf_dir), _ARM_CHECKS[:1]).select("doc_id", "grp", "status", "computed", "printed")


@query(_ARMS_SQL + """
SELECT 'by_flag' AS "check", status, count(*) AS n FROM r GROUP BY 2
UNION ALL SELECT 'grand', 'not_applicable', count(DISTINCT s) FROM i
""")
def ladder_fused(spark, sf_dir):
    return ladder.reconcile(_arms(spark, sf_dir), _ARM_CHECKS).groupBy("check", "status").agg(F.count(F.lit(1)).alias("n"))


@query(_ARMS_SQL + """
, v AS (SELECT s, max(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) depth, count(*) FILTER (WHERE status <> 'pass') bad, count(*) n FROM r GROUP BY s)
SELECT CAST(s AS BIGINT) AS doc_id, CAST(depth AS BIGINT) AS depth, CAST(n + 1 AS BIGINT) AS checks_total, CAST(n + 1 - bad AS BIGINT) AS checks_ok,
       depth = 1 AND bad = 0 AS verified,
       CASE WHEN depth = 1 AND bad = 0 THEN 'verified' WHEN depth = 0 THEN 'nothing could be verified' ELSE 'reconciliation failed' END AS status FROM v
""")
def verdict_depth(spark, sf_dir):
    rows = _arms(spark, sf_dir)
    return ladder.verdicts(rows, ladder.reconcile(rows, _ARM_CHECKS)).select("doc_id", "depth", "checks_total", "checks_ok", "verified", "status")


@query(_ARMS_SQL + """
, d AS (SELECT s, computed - printed AS delta FROM r WHERE printed IS NOT NULL)
SELECT CAST(x.s AS BIGINT) AS doc_id, CAST((SELECT max_by(delta, abs(delta)) FROM d WHERE d.s = x.s) AS DECIMAL(18,2)) AS worst_delta FROM (SELECT DISTINCT s FROM i) x
""")
def worst_delta(spark, sf_dir):
    rows = _arms(spark, sf_dir)
    return ladder.verdicts(rows, ladder.reconcile(rows, _ARM_CHECKS)).select("doc_id", "worst_delta")


# ---- amounts in text


@query("SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def parse_money_roundtrip(spark, sf_dir):
    token = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast(AMOUNT), 2))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), M.parse_money(token).alias("v")).groupBy("k").agg(F.sum("v").cast(AMOUNT).alias("v"), F.count("v").alias("n"))


@query("""
WITH x AS (SELECT o_orderkey % 9 AS style, CAST(o_totalprice AS DECIMAL(18,2)) v FROM orders)
SELECT style, CASE WHEN style IN (7, 8) THEN NULL ELSE CAST(sum(CASE WHEN style IN (1, 2, 3, 4) THEN -v ELSE v END) AS DECIMAL(18,2)) END AS v,
       CASE WHEN style IN (7, 8) THEN 0 ELSE count(*) END AS n FROM x GROUP BY 1
""")
def parse_money_signs(spark, sf_dir):
    v = F.col("o_totalprice").cast(AMOUNT)
    us = F.format_number(v, 2)
    eu = F.translate(us, ",.", ".,")
    style = F.col("o_orderkey") % 9
    forms = [us, F.concat(F.lit("-$"), us), F.concat(F.lit("$-"), us), F.concat(F.lit("("), us, F.lit(")")), F.concat(us, F.lit("-")), F.concat(F.lit("€"), eu), F.concat(F.lit("("), us), F.concat(us, F.lit("1")), F.format_string("%d", F.col("o_orderkey"))]
    token = forms[-1]
    for k in reversed(range(len(forms) - 1)):
        token = F.when(style == k, forms[k]).otherwise(token)
    return table(spark, sf_dir, "orders").select(style.alias("style"), M.parse_money(token).alias("v")).groupBy("style").agg(F.sum("v").cast(AMOUNT).alias("v"), F.count("v").alias("n"))


def _priced_lines(spark, sf_dir) -> DataFrame:
    price, tax = F.format_number(F.col("l_extendedprice").cast(AMOUNT), 2), F.format_number((F.col("l_quantity") * 3).cast(AMOUNT), 2)
    line = F.concat(F.lit("  Part "), F.col("l_partkey"), F.lit("  "), F.col("l_returnflag"), F.lit(" $"), price, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  ("), tax, F.lit(")"))).otherwise(F.lit(" Y")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"))


@query("""
WITH x AS (SELECT l_orderkey k, l_linenumber % 2 = 0 AS two, CAST(l_extendedprice AS DECIMAL(18,2)) p, CAST(l_quantity * 3 AS DECIMAL(18,2)) t FROM lineitem)
SELECT k, CAST(sum(CASE WHEN two THEN 2 ELSE 1 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN two THEN -t ELSE p END) AS DECIMAL(18,2)) AS last_sum,
       CAST(sum(CASE WHEN two THEN p - t ELSE p END) AS DECIMAL(18,2)) AS all_sum FROM x GROUP BY 1
""")
def money_tokens_per_line(spark, sf_dir):
    line = F.col("line")
    each = _priced_lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.size(M.money_tokens(line)).alias("t"), M.last_money(line).alias("l"), M.sum_money(line).alias("a"))
    return each.groupBy("k").agg(F.sum("t").cast("long").alias("tokens"), F.sum("l").cast(AMOUNT).alias("last_sum"), F.sum("a").cast(AMOUNT).alias("all_sum"))


@query("SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v, CAST(NULL AS DECIMAL(18,2)) AS bad FROM orders")
def decimal_field_coercion(spark, sf_dir):
    shown = F.concat(F.lit(" $"), F.format_number(F.col("o_totalprice").cast(AMOUNT), 2))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), M.decimal_field(shown).alias("v"), M.decimal_field(F.concat(F.lit("n/a "), shown)).alias("bad"))


# ---- lines of documents


def _lines(spark, sf_dir) -> DataFrame:
    return D.to_lines(D.to_pages(table(spark, sf_dir, "documents")))


_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)
"""


@query(_LINES_SQL + r"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '\S')) AS n_filled, CAST(max(line_no) AS BIGINT) AS last_line FROM l GROUP BY 1")
def doc_lines(spark, sf_dir):
    filled = ~T.is_blank(F.col("line"))
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(filled).alias("n_filled"), F.max("line_no").cast("long").alias("last_line"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS page_count, CAST(length(replace(replace(coalesce(text, ''), ' ', ''), chr(9), '')) AS DOUBLE) AS chars_per_page, length(replace(replace(coalesce(text, ''), ' ', ''), chr(9), '')) < 200 AS needs_ocr FROM documents")
def line_density(spark, sf_dir):
    out = D.document_density(D.to_pages(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("page_count").cast("long").alias("page_count"), "chars_per_page", "needs_ocr")


@query("""
WITH p AS (SELECT conv_id, turn, length(replace(replace(text, ' ', ''), chr(9), '')) AS chars FROM conversations),
     d AS (SELECT conv_id, avg(chars) < 200 AS needs FROM p GROUP BY 1)
SELECT p.conv_id AS doc_id, string_agg(CAST(turn + 1 AS VARCHAR), ',' ORDER BY turn) AS sparse FROM p JOIN d USING (conv_id) WHERE NOT needs AND chars < 200 GROUP BY 1
""")
def sparse_units(spark, sf_dir):
    """Each turn is a page of its conversation."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    out = D.document_density(pages).where(F.size("sparse_pages") > 0)
    return out.select("doc_id", F.array_join(F.transform("sparse_pages", lambda x: x.cast("string")), ",").alias("sparse"))


_TOKEN = r"(?:\()?(?:-)?(?:[$€£]|USD)?(?:-)?(?:[0-9]{1,3}(?:[,.][0-9]{3})*[,.][0-9]{2}|[0-9]+[,.][0-9]{2})(?:-)?(?:\))?"


@query(_LINES_SQL + rf"""
, a AS (SELECT doc_id, line_no, regexp_replace(line, '\s+$', '') AS x FROM l WHERE regexp_matches(line, '\S')),
b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '(^|\s){_TOKEN}($|\s)', '\1$\2', 'g'), '(^|\s){_TOKEN}($|\s)', '\1$\2', 'g') AS x FROM a),
c AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '[0-9][0-9,]*(?:\.[0-9]+)?', 'N', 'g'), '[A-Za-z][A-Za-z''./&-]*', 'W', 'g') AS x FROM b),
d AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s{{2,}}', ' | ', 'g') AS x FROM c),
e AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '(?:W ?)+', 'W ', 'g'), '(?:N ?)+', 'N ', 'g') AS x FROM d),
f AS (SELECT doc_id, line_no, substring(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 90) AS shape FROM e)
SELECT shape, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, min((doc_id, line_no)) LIMIT 40
""")
def shape_histogram_topk(spark, sf_dir):
    return discover.line_shapes(_lines(spark, sf_dir), examples=0)


_DOC_RULES = [
    rules.Rule("notice", "header_field", r"(?i)licen[sc]ed|released under"),
    rules.Rule("table", "column_header", r" \| "),
    rules.Rule("shout", "restatement", r"!!", nums={"amount": lambda ctx: F.length(ctx.line)}),
    rules.Rule("marked", "section_header", r"[#*$%&]{3}"),
    rules.Rule("short", "continuation", r"^\S{1,12}$"),
    rules.Rule("stop", "charge", r"\.$", nums={"amount": lambda ctx: F.length(ctx.line)}),
]


@query(_LINES_SQL + r"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(line, '(?i)licen[sc]ed|released under') THEN 'header_field' WHEN regexp_matches(line, ' \| ') THEN 'column_header'
  WHEN regexp_matches(line, '!!') THEN 'restatement' WHEN regexp_matches(line, '[#*$%&]{3}') THEN 'section_header' WHEN regexp_matches(line, '^\S{1,12}$') THEN 'continuation'
  WHEN regexp_matches(line, '\.$') THEN 'charge' ELSE 'unclassified' END AS kind FROM l WHERE regexp_matches(line, '\S')) GROUP BY 1
""")
def classify_counts(spark, sf_dir):
    return rules.classify(_lines(spark, sf_dir), _DOC_RULES).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_LINES_SQL + r"""
, f AS (SELECT * FROM l WHERE regexp_matches(line, '\S')),
w AS (SELECT doc_id, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM f)
SELECT doc_id, CAST(coalesce(sum(length(p)), 0) AS BIGINT) AS before, CAST(coalesce(sum(length(n)), 0) AS BIGINT) AS after FROM w GROUP BY 1
""")
def next_nonblank(spark, sf_dir):
    out = rules.with_context(_lines(spark, sf_dir)).where("not is_blank")
    return out.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("previous_line")), F.lit(0)).cast("long").alias("before"), F.coalesce(F.sum(F.length("next_line")), F.lit(0)).cast("long").alias("after"))


# ---- windows over ordered rows


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"), F.col("value").cast(AMOUNT).alias("v"))


@query("""
WITH z AS (SELECT user_id, coalesce(last_value(CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'signup' THEN 'fresh' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'body') AS zone FROM events)
SELECT user_id AS doc_id, zone, count(*) AS n FROM z GROUP BY 1, 2
""")
def zone_forward_fill(spark, sf_dir):
    zones = [rules.Zone("p", "^purchase$", "bought"), rules.Zone("s", "^signup$", "fresh")]
    return rules.with_zones(_events(spark, sf_dir), zones).groupBy("doc_id", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT user_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM events)
SELECT user_id AS doc_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM s GROUP BY 1, 2
""")
def section_counter(spark, sf_dir):
    w = folds.ordered(["doc_id"], ["line_no"])
    return _events(spark, sf_dir).withColumn("section", folds.sections(F.col("line") == "purchase", w).cast("long")).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT user_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM events),
     c AS (SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, section) THEN section END AS section FROM s)
SELECT user_id AS doc_id, count(*) FILTER (WHERE section IS NULL) AS open_rows, count(*) AS n FROM c GROUP BY 1
""")
def unclosed_sections(spark, sf_dir):
    out = folds.closed_sections(_events(spark, sf_dir), ["doc_id"], ["line_no"], F.col("line") == "purchase")
    return out.groupBy("doc_id").agg(F.count_if(F.col("section").isNull()).alias("open_rows"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v,
  last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kind FROM events
""")
def asof_last_kind(spark, sf_dir):
    w = folds.ordered(["doc_id"], ["line_no"])
    ev = _events(spark, sf_dir)
    return ev.select("event_id", folds.last_of(["purchase"], F.col("v"), w, "line").alias("v"), folds.last_but(["view"], F.col("line"), w, "line").alias("kind"))


@query("""
WITH h AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id, min(turn) AS turn, sha256(string_agg(text, ' ' ORDER BY turn)) AS folded, count(*) AS n_lines FROM h WHERE g > 0 GROUP BY conv_id, g
""")
def fold_continuations(spark, sf_dir):
    out = folds.fold_wrapped(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "text")
    return out.select("conv_id", "at.turn", F.sha2(F.col("text").cast("binary"), 256).alias("folded"), "n_lines")


@query("""
WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r, count(*) OVER (PARTITION BY conv_id) n FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, length(text) size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r, count(*) OVER (PARTITION BY conv_id) m FROM conversations WHERE role = 'assistant'),
     b AS (SELECT l.*, a.size, coalesce(max(a.m) OVER (PARTITION BY l.conv_id), 0) AS m, a.r IS NOT NULL AS hit FROM l LEFT JOIN a ON l.conv_id = a.conv_id AND l.r = a.r),
     c AS (SELECT *, n = m AND bool_and(hit) OVER (PARTITION BY conv_id) AS paired FROM b)
SELECT conv_id, turn, paired, CAST(CASE WHEN paired THEN size END AS BIGINT) AS right_size FROM c
""")
def positional_pairing(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("same", F.lit(1))
    left = conv.where("role = 'user'").select("conv_id", "turn", "same")
    right = conv.where("role = 'assistant'").select("conv_id", "turn", "same", F.length("text").cast("long").alias("size"))
    return folds.pair_by_place(left, right, ["conv_id"], ["turn"], "same").select("conv_id", "turn", "paired", "right_size")


@query("""
WITH t AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) v, CASE WHEN o_orderstatus = 'F' THEN CAST(1.50 AS DECIMAL(18,2)) END cr, o_orderkey FROM orders)
SELECT o_orderkey AS k, CAST(v - coalesce(sum(cr) OVER (PARTITION BY o_custkey), 0) AS DECIMAL(18,2)) AS net FROM t
""")
def credit_netting(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast(AMOUNT).alias("v"), F.when(F.col("o_orderstatus") == "F", F.lit("1.50").cast(AMOUNT)).alias("cr"))
    return folds.net_credits(rows, ["o_custkey"], "v", "cr").select("k", F.col("net").cast(AMOUNT).alias("net"))


@query("SELECT o_custkey AS doc_id, count(*) FILTER (WHERE o_orderstatus = 'F') > 1 AS container, count(*) AS n FROM orders GROUP BY 1")
def container_refusal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    return folds.refuse_containers(rows, F.col("o_orderstatus") == "F").groupBy("doc_id", "container").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS cut FROM events GROUP BY 1)
SELECT e.user_id AS doc_id, count(*) AS n FROM events e JOIN m USING (user_id) WHERE cut IS NULL OR event_id < cut GROUP BY 1
""")
def cut_at_marker(spark, sf_dir):
    return folds.cut_at(_events(spark, sf_dir), ["doc_id"], ["line_no"], F.col("line") == "purchase").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- columns, headers, fingerprints

@query("SELECT p_partkey AS k, trim(p_name) AS name, p_brand AS brand, p_type AS kind FROM part")
def fixed_width_slice(spark, sf_dir):
    name, brand, kind = (F.coalesce(c, F.lit("")) for c in ("p_name", "p_brand", "p_type"))
    # columns are as wide as their row needs
    w, v = F.greatest(F.lit(30), F.length(name)), F.greatest(F.lit(12), F.length(brand))
    line = F.concat(F.rpad(name, w, F.lit(" ")), F.rpad(brand, v, F.lit(" ")), kind)
    header = F.concat(F.rpad(F.lit("Name"), w, F.lit(" ")), F.rpad(F.lit("Brand"), v, F.lit(" ")), F.lit("Type"))
    cells = T.slice_columns(line, T.column_offsets(header, ["Type", "Name", "Brand", "Missing"]))
    cell = lambda label, c: F.when(F.col(c).isNotNull(), cells[label])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), cell("Name", "p_name").alias("name"), cell("Brand", "p_brand").alias("brand"), cell("Type", "p_type").alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 60 >= 40 THEN 'Type' WHEN doc_id % 60 >= 28 THEN 'Brand' WHEN doc_id % 60 >= 3 THEN 'Name' END AS label FROM documents")
def point_in_range_column(spark, sf_dir):
    columns = T.column_offsets(F.lit("   Name                     Brand       Type"), ["Name", "Brand", "Type"])
    return table(spark, sf_dir, "documents").select("doc_id", T.field_at(columns, F.col("doc_id") % 60).alias("label"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def header_field_first_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.header_field(F.col("html"), "<title>([^<]*)</title>").alias("title"))


@query(r"""
WITH s AS (SELECT substring(sha256(source || '|' || list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(substring(text, 1, 40), '[A-Za-z#/]{2,}'), lambda x: upper(x)))), 'string_agg', ',')), 1, 16) AS signature, doc_id
           FROM documents WHERE regexp_matches(substring(text, 1, 40), '[A-Za-z#/]{2}'))
SELECT signature, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY 1
""")
def layout_signature_clusters(spark, sf_dir):
    head = F.substring("text", 1, 40)
    docs = table(spark, sf_dir, "documents").where(head.rlike("[A-Za-z#/]{2}"))
    made = docs.select("doc_id", T.signature(F.col("source"), head).alias("signature"))
    return made.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
WITH r AS (SELECT o_orderpriority p, CAST(o_totalprice AS DECIMAL(18,2)) v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice AS DECIMAL(18,2))) - 1 k, count(*) OVER (PARTITION BY o_orderpriority) n FROM orders)
SELECT p, v AS median FROM r WHERE k = n // 2
""")
def upper_median_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").cast(AMOUNT).alias("v"))
    return profiles.upper_median(rows, "v", "p")


@query(_LINES_SQL + r"""
, s AS (SELECT doc_id, count(DISTINCT len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> ''))) AS shapes FROM l WHERE regexp_matches(line, '\S') GROUP BY 1)
SELECT doc_id, CAST(1 AS BIGINT) AS page_count, CAST(coalesce(shapes, 0) AS BIGINT) AS shapes FROM documents LEFT JOIN s USING (doc_id) ORDER BY 3 DESC, 1 DESC LIMIT 1
""")
def representative_pick(spark, sf_dir):
    pages = D.to_pages(table(spark, sf_dir, "documents"))
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    return profiles.representative(counted, D.to_lines(pages)).select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.col("shapes").cast("long").alias("shapes"))


# ---- grammar search


def _made_invoices(spark, sf_dir) -> DataFrame:
    """Lines of one invoice a supplier: dated items, then their total; odd ones print no dollar sign."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").cast(AMOUNT).alias("v"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("n"))
    sign = F.when(F.col("s") % 2 == 0, "$").otherwise("")
    lines = items.select(F.col("s").alias("doc_id"), F.lit(1).alias("page"), F.col("n").alias("line_no"), F.concat(F.lit("01/02/2024  item row  "), sign, F.format_number("v", 2)).alias("line"))
    totals = items.groupBy("s").agg(F.sum("v").cast(AMOUNT).alias("v"))
    total = totals.select(F.col("s").alias("doc_id"), F.lit(2).alias("page"), F.lit(0).alias("line_no"), F.concat(F.lit("Invoice Total  "), sign, F.format_number("v", 2)).alias("line"))
    return lines.unionByName(total)


_FITS_SQL = """
WITH t AS (SELECT l_suppkey s, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) v, count(*) n FROM lineitem GROUP BY 1),
     w AS (SELECT * FROM (VALUES ('exactly_1_money', 2), ('leading_date', 2), ('has_currency_symbol', 0), ('no_currency_symbol', 1)) x(strategy, odd)),
     a AS (SELECT * FROM (VALUES ('last_money'), ('sum_of_row_money')) x(aggregate)),
     f AS (SELECT s AS doc_id, strategy, aggregate, 'invoice total' AS total_label, v AS computed, n AS n_rows FROM t, w, a WHERE odd = 2 OR odd = s % 2)
"""


@query(_FITS_SQL + "SELECT * FROM f")
def cross_search_closes(spark, sf_dir):
    lines = durable(_made_invoices(spark, sf_dir), "lines")
    return discover.search(lines, discover.total_candidates(lines)).select("doc_id", "strategy", "aggregate", "total_label", "computed", "n_rows")


@query(_FITS_SQL + "SELECT strategy, aggregate, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) = (SELECT count(*) FROM t) AS unanimous FROM f GROUP BY 1, 2")
def consensus_unanimous(spark, sf_dir):
    lines = durable(_made_invoices(spark, sf_dir), "lines")
    found = discover.search(lines, discover.total_candidates(lines))
    return discover.consensus(found, lines).select("strategy", "aggregate", "n", "unanimous")


# ---- state


def _versions(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.substring(F.coalesce("text", F.lit("")), 1, 12).alias("identity"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), (F.col("n_chars") % 7).cast(AMOUNT).alias("printed_total"), F.col("doc_id").alias("seq"))


_VERSIONS_SQL = "WITH v AS (SELECT substring(coalesce(text, ''), 1, 12) AS identity, sha256(coalesce(text, '')) AS sha, CAST(n_chars % 7 AS DECIMAL(18,2)) AS total, doc_id AS seq FROM documents)"


@query(_VERSIONS_SQL + "SELECT identity, max_by(sha, seq) AS sha256, max(seq) AS seq FROM v WHERE trim(identity) <> '' GROUP BY 1")
def latest_by_identity(spark, sf_dir):
    return state.latest(_versions(spark, sf_dir)).select("identity", "sha256", "seq")


@query(_VERSIONS_SQL + """
, h AS (SELECT identity, max_by(sha, seq) AS sha, max_by(total, seq) AS total FROM v WHERE seq % 3 = 0 AND trim(identity) <> '' GROUP BY 1),
b AS (SELECT v.*, lag(v.sha) OVER w AS psha, lag(v.total) OVER w AS ptotal, h.sha AS hsha, h.total AS htotal FROM v LEFT JOIN h ON v.identity = h.identity WHERE seq % 3 <> 0 WINDOW w AS (PARTITION BY v.identity ORDER BY seq)),
c AS (SELECT *, coalesce(psha, hsha) AS ksha, CASE WHEN psha IS NOT NULL THEN ptotal ELSE htotal END AS ktotal FROM b)
SELECT seq, CASE WHEN trim(identity) = '' THEN 'changed' WHEN ksha IS NULL THEN 'new' WHEN ksha = sha THEN 'duplicate' ELSE 'changed' END AS verdict,
  CASE WHEN trim(identity) = '' THEN 'no identity' WHEN ksha IS NOT NULL AND ksha <> sha THEN CASE WHEN ktotal IS NOT DISTINCT FROM total THEN 'same total, other bytes' ELSE 'totals differ' END END AS reason FROM c
""")
def triage_verdicts(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return state.triage(v.where("seq % 3 <> 0"), v.where("seq % 3 = 0")).select("seq", "verdict", "reason")


def _settled_sql(batch: str, history: str, rest: int) -> str:
    """Verdicts of one batch in SQL, as ``batch``, against the table ``history`` (identity, sha, total)."""
    return f"""
, {batch}_w AS (SELECT v.*, lag(v.sha) OVER w AS psha, lag(v.total) OVER w AS ptotal, h.sha AS hsha, h.total AS htotal FROM v LEFT JOIN {history} h ON v.identity = h.identity WHERE seq % 3 = {rest} WINDOW w AS (PARTITION BY v.identity ORDER BY seq)),
{batch}_k AS (SELECT *, coalesce(psha, hsha) AS ksha, CASE WHEN psha IS NOT NULL THEN ptotal ELSE htotal END AS ktotal FROM {batch}_w),
{batch} AS (SELECT seq, identity, sha, total, CASE WHEN trim(identity) = '' THEN 'changed' WHEN ksha IS NULL THEN 'new' WHEN ksha = sha THEN 'duplicate' ELSE 'changed' END AS verdict,
  CASE WHEN trim(identity) = '' THEN 'no identity' WHEN ksha IS NOT NULL AND ksha <> sha THEN CASE WHEN ktotal IS NOT DISTINCT FROM total THEN 'same total, other bytes' ELSE 'totals differ' END END AS reason FROM {batch}_k)"""


@query(
    _VERSIONS_SQL
    + ", h0 AS (SELECT identity, max_by(sha, seq) AS sha, max_by(total, seq) AS total FROM v WHERE seq % 3 = 0 AND trim(identity) <> '' GROUP BY 1)"
    + _settled_sql("b1", "h0", 1)
    + ", h1 AS (SELECT * FROM h0 UNION ALL SELECT identity, sha, total FROM b1 WHERE verdict = 'new')"
    + _settled_sql("b2", "h1", 2)
    + "SELECT 1 AS run, seq, verdict, reason FROM b1 UNION ALL SELECT 2, seq, verdict, reason FROM b2"
)
def incremental_runs(spark, sf_dir):
    """Two batches after a history: what the first records, the second knows; every document is recorded or reported."""
    v = _versions(spark, sf_dir)
    history, out = v.where("seq % 3 = 0"), []
    for run in (1, 2):
        new, rest = state.settle(v.where(F.col("seq") % 3 == run), history)
        history = history.unionByName(new.select(*history.columns))
        every = new.select("seq", F.lit("new").alias("verdict"), F.lit(None).cast("string").alias("reason")).unionByName(rest.select("seq", "verdict", "reason"))
        out.append(every.select(F.lit(run).alias("run"), "*"))
    return out[0].unionByName(out[1])


@query(_VERSIONS_SQL + "SELECT seq, identity FROM v WHERE seq % 2 = 1 AND identity NOT IN (SELECT identity FROM v WHERE seq % 2 = 0)")
def new_only_append(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return state.only_new(v.where("seq % 2 = 1"), v.where("seq % 2 = 0")).select("seq", "identity")


@query(_VERSIONS_SQL + """
SELECT cause, count(*) AS n, sum(length(detail)) AS size FROM (
  SELECT 'unusable' AS cause, source AS detail FROM documents WHERE n_chars < 200
  UNION ALL SELECT 'unknown language', lang FROM documents WHERE lang NOT IN ('en', 'de')
  UNION ALL SELECT 're-issued', identity FROM v WHERE seq % 10 = 0) GROUP BY 1
""")
def exceptions_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    causes = [
        ("unusable", docs.where("n_chars < 200").select("doc_id", F.col("source").alias("detail"))),
        ("unknown language", docs.where("lang not in ('en', 'de')").select("doc_id", F.col("lang").alias("detail"))),
        ("re-issued", _versions(spark, sf_dir).where("seq % 10 = 0").select(F.col("seq").alias("doc_id"), F.col("identity").alias("detail"))),
    ]
    return state.exceptions(*causes).groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("detail")).alias("size"))


# ---- whole invoices


@query("""
WITH x AS (SELECT l_orderkey k, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem),
     s AS (SELECT k, sum(v) v, count(*) n FROM x GROUP BY 1)
SELECT k AS doc_id, k % 10 <> 3 AS verified, CASE WHEN k % 10 = 3 THEN 'reconciliation failed' ELSE 'verified' END AS status,
       CAST(CASE WHEN k % 10 = 3 THEN 2 ELSE 4 END AS BIGINT) AS depth, n AS items, CAST(v AS DECIMAL(18,2)) AS computed_total FROM s
""")
def invoice_extraction(spark, sf_dir):
    """Invoices printed from orders, read back from their text and reconciled; every tenth prints wrong sums."""
    return invoices.extract(invoices.printed(table(spark, sf_dir, "lineitem"))).select("doc_id", "verified", "status", "depth", "items", "computed_total")


@query("""
WITH x AS (SELECT l_orderkey k, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem)
SELECT k AS doc_id, CAST(v AS DECIMAL(18,2)) AS amount, count(*) AS n FROM x GROUP BY 1, 2
""")
def invoice_line_items(spark, sf_dir):
    rows = invoices.classified(invoices.printed(table(spark, sf_dir, "lineitem")))
    return sinks.line_items(rows, ("description", "quantity")).groupBy("doc_id", "amount").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT count(DISTINCT l_orderkey) m, count(*) n, count(DISTINCT (l_orderkey, l_returnflag)) f FROM lineitem)
SELECT kind, CASE kind WHEN 'charge' THEN n WHEN 'continuation' THEN n WHEN 'restatement' THEN f ELSE m END AS n
FROM o, (VALUES ('charge'), ('continuation'), ('restatement'), ('column_header'), ('section_header'), ('header_field'), ('invoice_subtotal'), ('tax'), ('grand_total'), ('row_count')) k(kind)
""")
def classify_sequential_fallback(spark, sf_dir):
    lines = invoices.printed(table(spark, sf_dir, "lineitem"))
    return rules.classify_in_order(lines, invoices.RULES, invoices.ZONES).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- every layout, printed from orders and read back


def _layout_query(name: str, depth: tuple[int, int], texts: tuple[str, ...], size: str, *, amount: str = "v", identity: str = "CAST(k AS VARCHAR)") -> None:
    """Registers layout_<name>: rungs passed when all closes and when a total is off; what an item's texts measure, in SQL."""

    def read(spark, sf_dir):
        return printed.read_back(table(spark, sf_dir, "lineitem"), name, texts)

    read.__name__ = f"layout_{name}"
    query(f"""
WITH x AS (SELECT l_orderkey k, CAST(l_partkey AS VARCHAR) p, l_returnflag f, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem)
SELECT k AS doc_id, {identity} AS identity, k % 10 <> 3 AS verified, CAST(CASE WHEN k % 10 = 3 THEN {depth[1]} ELSE {depth[0]} END AS BIGINT) AS depth,
       count(*) AS items, CAST(sum({amount}) AS DECIMAL(18,2)) AS computed_total, CAST(sum({size}) AS BIGINT) AS size FROM x GROUP BY k
""")(read)


_layout_query("rate_table", (2, 1), ("description", "rate"), "length('Part ' || p) + 4", identity="CAST(k + 100000 AS VARCHAR)")
_layout_query("two_fees", (4, 2), ("county", "reference", "last_name"), "length('Kings' || p || '7' || 'DOE')", amount="v + 4.50")
_layout_query("unit_rates", (6, 5), ("description", "unit"), "length('Part ' || p || '| Ref #: ' || p || 'EA')")
_layout_query("sections", (4, 3), ("dept", "employee", "material", "description"), "length('FLAG ' || f || '0001' || 'X100' || 'PART ' || p || ' WRAP/' || p)")
_layout_query("summary_and_detail", (14, 13), ("search_id", "description"), "length(p || 'Part ' || p || ' LOS ANGELES, CA')", amount="v + 3.00")
_layout_query("regrouped", (10, 9), ("service_group", "service_name", "gl_code"), "length('County ' || f || 'Part ' || p || '50130-004')")


def _section_records(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    out = _section_run(spark, sf_dir)
    facts = sinks.document_facts(out["rows"], out["results"])
    return sinks.records(out["verdicts"], out["heads"], out["items"], facts, "sections"), facts, out["verdicts"]


@query("""
WITH x AS (SELECT l_orderkey k, l_returnflag f, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem),
     s AS (SELECT k, sum(v) v, count(*) n, count(DISTINCT f) fs, string_agg(DISTINCT 'FLAG ' || f, ', ' ORDER BY 'FLAG ' || f) depts, CASE WHEN k % 10 = 3 THEN 0.01 ELSE 0.00 END AS off FROM x GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS invoice_number, '01/02/2024' AS invoice_date, CASE WHEN off > 0 THEN 'reconciliation failed' ELSE 'verified' END AS status, 2 AS pages, CAST(n AS INTEGER) AS line_items,
  CAST(v AS DECIMAL(18,2)) AS computed_total, CAST(v + off AS DECIMAL(18,2)) AS printed_subtotal, CAST(1.00 AS DECIMAL(18,2)) AS tax, CAST(v + off + 1.00 AS DECIMAL(18,2)) AS printed_total,
  CAST(-off AS DECIMAL(18,2)) AS delta, (2 * fs + 3 - CAST(off > 0 AS INTEGER)) || '/' || (2 * fs + 3) AS checks, CAST(CASE WHEN off > 0 THEN 3 ELSE 4 END AS INTEGER) AS depth, depts AS departments,
  '' AS service_ticket, '' AS customer_ref, '' AS user_id, '' AS sold_to, '' AS payer, '' AS payment_terms, '' AS sort_number, '' AS route, '' AS ocr, CAST(k AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS notes FROM s
""")
def fact_rows(spark, sf_dir):
    """The 25 columns of the fact row but the time of the run."""
    records_, facts, verdicts = _section_records(spark, sf_dir)
    return sinks.invoices(records_, facts, verdicts).drop("extracted_at", "verified", "flagged")


@query("""
WITH x AS (SELECT l_orderkey k, l_partkey p, l_returnflag f, CAST(l_quantity AS BIGINT) q, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem)
SELECT CAST(k AS VARCHAR) AS invoice_number, '01/02/2024' AS invoice_date, 'FLAG ' || f AS department, '0001' AS employee, 'X100' AS material, 'PART ' || p || ' WRAP/' || p AS description,
  '' AS variant, '01' AS freq, 'F' AS exch, CAST(q AS VARCHAR) AS qty, '1.25' AS unit_price, v AS line_total, 'Y' AS taxable, 1 AS page FROM x
""")
def denormalised_items(spark, sf_dir):
    return sinks.invoice_items(_section_records(spark, sf_dir)[0])


@query("""
WITH x AS (SELECT l_orderkey k, CAST(l_partkey AS VARCHAR) p, l_returnflag f, CAST(l_extendedprice AS DECIMAL(18,2)) v FROM lineitem)
SELECT k AS doc_id, (k + 1000000) || '|123456' AS identity, k % 10 NOT IN (3, 7) AS verified, CAST(CASE k % 10 WHEN 7 THEN 0 WHEN 3 THEN 15 ELSE 16 END AS BIGINT) AS depth,
  count(*) + 1 AS items, CAST(sum(v) + 2.00 AS DECIMAL(18,2)) AS computed_total,
  CAST(sum(length('55' || 'Some Account' || 'L' || f || 'D' || p || 'Part ' || p || 'ID' || p || ' MCEL' || '1000000000' || 'ABCDEFGHIJKL' || 'DOE JOHN')) + length('55' || 'PO9' || 'P1' || 'Cup' || '1.00') AS BIGINT) AS size
FROM x GROUP BY k
""")
def layout_two_templates(spark, sf_dir):
    texts = ("account_number", "account_name", "location", "purchase_order", "code", "description", "unit_price", "sample_id", "accession", "reference", "donor", "patient_detail")
    return printed.read_back(table(spark, sf_dir, "lineitem"), "two_templates", texts)


@query("""
WITH x AS (SELECT l_orderkey k, l_partkey pk, CAST(l_partkey AS VARCHAR) p, l_returnflag f, CAST(l_extendedprice AS DECIMAL(18,2)) v,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_quantity AS BIGINT)) AS r FROM lineitem),
g AS (SELECT k, f, sum(CASE WHEN r > 1 THEN length('X' || p || 'Y' || p) ELSE 0 END) + greatest(2 * (count(*) - 1) - 1, 0) AS pieces FROM x GROUP BY 1, 2),
s AS (SELECT k, count(*) n, sum(v) v, sum(length('DOE JOHN' || '01/02/24' || 'ACC' || f || 'D' || p || 'Part ' || p || 'MB')) AS size FROM x GROUP BY 1)
SELECT s.k AS doc_id, (s.k + 1000000) || '|123456' AS identity, s.k % 10 <> 3 AS verified, CAST(CASE WHEN s.k % 10 = 3 THEN 2 ELSE 3 END AS BIGINT) AS depth, s.n AS items, CAST(s.v AS DECIMAL(18,2)) AS computed_total,
  CAST(s.size + (SELECT sum(pieces) FROM g WHERE g.k = s.k) AS BIGINT) AS size FROM s
""")
def layout_statement_grid(spark, sf_dir):
    """The second template: patients' cells carried down the grid, wrapped pieces gathered, and the stub of the document's own number."""
    texts = ("donor", "service_date", "accession", "code", "description", "lab_code", "patient_detail")
    return printed.read_back(table(spark, sf_dir, "lineitem"), "two_templates", texts, printed.statement_grid)


def _section_run(spark, sf_dir) -> dict[str, DataFrame]:
    lines = printed.on_paper(table(spark, sf_dir, "lineitem"), printed.sections)
    out = layouts.run(lines, layouts.SECTIONS)
    discard(lines)
    return out


@query("""
WITH o AS (SELECT DISTINCT l_orderkey k FROM lineitem),
c(check_no, "check") AS (VALUES (0, 'employee_subtotal'), (1, 'section_subtotal'), (2, 'invoice_subtotal'), (3, 'grand_total'), (4, 'restatement'))
SELECT check_no, "check", CASE WHEN check_no = 4 THEN 'n/a' WHEN check_no = 2 AND k % 10 = 3 THEN 'FAIL' ELSE 'PASS' END AS state, count(*) AS n FROM o CROSS JOIN c GROUP BY 1, 2, 3
""")
def check_states(spark, sf_dir):
    return sinks.sample_report(_section_run(spark, sf_dir)["results"]).groupBy("check_no", "check", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT l_orderkey AS doc_id, 'invoice_subtotal' AS "check", CAST(-0.01 AS DECIMAL(18,2)) AS delta, 'computed is short' AS hint, CAST(NULL AS VARCHAR) AS match_kind FROM lineitem WHERE l_orderkey % 10 = 3
""")
def diagnosed_failures(spark, sf_dir):
    out = _section_run(spark, sf_dir)
    return ladder.diagnose(out["results"], out["rows"]).select("doc_id", "check", "delta", "hint", "match_kind")


# ---- documents of one piece, mixed folders, histories


@query("""
WITH e AS (SELECT event_id, event_type, CAST(value AS DECIMAL(18,2)) v, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events),
s AS (SELECT event_id,
  coalesce(last_value(CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'signup' THEN 'fresh' END IGNORE NULLS) OVER upto, 'body') AS zone,
  coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END) OVER earlier, 0) AS section,
  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER upto AS grp,
  last_value(CASE WHEN event_type = 'purchase' THEN v END IGNORE NULLS) OVER earlier AS bought,
  last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER earlier AS kind,
  first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER later AS click
  FROM e WINDOW upto AS (ORDER BY r ROWS UNBOUNDED PRECEDING), earlier AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), later AS (ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, zone, CAST(section AS BIGINT) AS section, CAST(grp AS BIGINT) AS grp, bought, kind, click FROM s
""")
def giant_document_scan(spark, sf_dir):
    """All events as one document, scanned in blocks: no block waits for another."""
    ev = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"), F.col("value").cast(AMOUNT).alias("v"))
    line = F.col("line")
    ways = {
        "zone": scans.carried(F.when(line == "purchase", "bought").when(line == "signup", "fresh")), "section": scans.counted(line == "purchase", upto=False), "grp": scans.counted(line == "click"),
        "bought": scans.carried(F.when(line == "purchase", F.col("v")), upto=False), "kind": scans.carried(F.when(line != "view", line), upto=False), "click": scans.Scan("next", F.when(line == "click", F.col("event_id"))),
    }
    out = scans.scan(ev, ways, block=4096)
    return out.select("event_id", F.coalesce("zone", F.lit("body")).alias("zone"), F.col("section").cast("long"), F.col("grp").cast("long"), "bought", "kind", "click")


@query("SELECT (SELECT v FROM (SELECT CAST(o_totalprice AS DECIMAL(18,2)) v, row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,2))) - 1 r, count(*) OVER () n FROM orders) WHERE r = n // 2) AS median, (SELECT max(v) FROM (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) v, row_number() OVER (ORDER BY CAST(l_extendedprice AS DECIMAL(18,2))) - 1 r, count(*) OVER () n FROM lineitem) WHERE r = n * 99 // 100) AS high")
def order_statistics(spark, sf_dir):
    """A median and a 99th percentile of whole columns, exact, by rounds of histograms."""
    total = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast(AMOUNT).alias("v"))
    price = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast(AMOUNT).alias("v"))
    high = profiles.order_statistic(price, "v", lambda n: n * 99 // 100)
    return profiles.upper_median(total, "v").select("median", F.lit(high).cast(AMOUNT).alias("high"))


MIXED = ("rate_table", "sections", "unit_rates", "summary_and_detail")


@query("""
WITH x AS (SELECT l_orderkey k, count(*) n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) v FROM lineitem GROUP BY 1)
SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'rate_table' WHEN 1 THEN 'sections' WHEN 2 THEN 'unit_rates' END AS spec, k % 10 <> 3 AS verified,
  CASE WHEN k % 5 = 3 THEN 'bound to another layout' WHEN k % 5 = 4 THEN 'no layout is bound' END AS cause, CASE WHEN k % 5 < 3 THEN v END AS computed_total FROM x WHERE k % 5 < 3
UNION ALL SELECT k, NULL, NULL, CASE WHEN k % 5 = 3 THEN 'bound to another layout' ELSE 'no layout is bound' END, NULL FROM x WHERE k % 5 > 2
""")
def mixed_folder(spark, sf_dir):
    """Documents of five kinds in one folder: three are read by their layouts, one is bound elsewhere, one is not known."""
    items = table(spark, sf_dir, "lineitem")
    kinds = (*MIXED, "two_fees")
    part = lambda k, name: printed.PRINTED[name](printed.Orders(items.where(F.col("l_orderkey") % 5 == k)))
    lines = durable(printed.together([part(k, name) for k, name in enumerate(kinds)]), "folder")
    heads = durable(profiles.header_rows(lines).select("doc_id", T.signature(F.lit("? / ?"), F.col("column_row")).alias("signature"), F.lit(True).alias("usable_text")), "profiles")
    # the signature of each kind's first document is bound, but for the last kind
    first = heads.groupBy((F.col("doc_id") % 5).alias("k")).agg(F.min_by("signature", "doc_id").alias("signature")).where(F.col("k") < 4)
    bindings = first.select("signature", F.get(F.array(*[F.lit(n) for n in MIXED]), F.col("k").cast("int")).alias("spec"))
    routes, refused = dispatch.route(heads, bindings, MIXED[:3])
    done = dispatch.extract(lines, routes, MIXED[:3]).select("doc_id", "spec", "verified", F.lit(None).cast("string").alias("cause"), "computed_total")
    return done.unionByName(refused.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("boolean").alias("verified"), "cause", F.lit(None).cast(AMOUNT).alias("computed_total")))


@query(_VERSIONS_SQL + """
, b AS (SELECT identity, sha, seq, seq % 3 AS part, row_number() OVER (PARTITION BY identity ORDER BY seq % 3 DESC, seq DESC) r FROM v WHERE trim(identity) <> '')
SELECT identity, sha AS sha256, CAST(part + 1 AS BIGINT) AS batch FROM b WHERE r = 1
""")
def ordered_history(spark, sf_dir):
    """Three batches committed one after the other, read back: of each identity the one written last."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    v = _versions(spark, sf_dir)
    for k in range(3):
        commits.write_batch(spark, path, f"b{k}", {"records": v.where(F.col("seq") % 3 == k).orderBy("seq").drop("seq")})
    return state.latest(commits.read_committed(spark, path, "records")).select("identity", "sha256", F.col("seq.batch").alias("batch"))


@query(_VERSIONS_SQL + "SELECT seq, identity FROM v WHERE seq % 4 = 1 AND identity NOT IN (SELECT identity FROM v WHERE seq % 4 <> 1)")
def bucketed_anti_join(spark, sf_dir):
    """New identities against a history of three committed batches that is laid out by identity."""
    path = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    v = _versions(spark, sf_dir)
    for k in (0, 2, 3):
        commits.write_batch(spark, path, f"b{k}", {"records": v.where(F.col("seq") % 4 == k)}, {"records": "identity"})
    return commits.unseen(spark, path, "records", v.where("seq % 4 = 1")).select("seq", "identity")


@query("""
SELECT l_orderkey AS doc_id, label, CAST(CASE label WHEN 'Part' THEN sum(length('P' || l_partkey)) ELSE sum(length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) END AS BIGINT) AS size, count(*) AS n
FROM lineitem, (VALUES ('Part'), ('Qty')) k(label) GROUP BY 1, 2
""")
def words_by_column(spark, sf_dir):
    """Words placed on pages of printed rows, dealt to columns by their middles."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1).cast("int").alias("line_no"), F.concat(F.rpad(F.concat(F.lit("P"), F.col("l_partkey").cast("string")), 20, " "), F.col("l_quantity").cast("long").cast("string"), F.lit("      rest")).alias("line"))
    columns = items.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit("Part").alias("label"), F.lit(0.0).alias("low"), F.lit(120.0).alias("high")), F.struct(F.lit("Qty").alias("label"), F.lit(120.0).alias("low"), F.lit(140.0).alias("high")))).alias("c")).select("doc_id", "c.*")
    cells = D.words_in_columns(D.placed_words(items), columns)
    return cells.groupBy("doc_id", "label").agg(F.sum(F.length("text")).alias("size"), F.count(F.lit(1)).alias("n"))


# ---- functions on their own


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(NULL AS DECIMAL(18,2)) AS strict FROM lineitem WHERE contains(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '1')")
def lenient_amounts(spark, sf_dir):
    """Amounts whose ones a scan printed as letters."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_number(F.col("l_extendedprice").cast(AMOUNT), 2).alias("t")).where(F.col("t").contains("1"))
    scanned = F.translate("t", "1", "l")
    return items.select("l_orderkey", "l_linenumber", M.parse_money(scanned, lenient=True).alias("value"), M.parse_money(scanned).alias("strict"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R', 'A') THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS value FROM lineitem")
def credit_signs(spark, sf_dir):
    v = F.col("l_extendedprice").cast(AMOUNT)
    text = F.when(F.col("l_returnflag") == "R", F.concat(v.cast("string"), F.lit(" CR"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("("), v.cast("string"), F.lit(")"))).otherwise(v.cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.credit(v, text).alias("value"))


def _hits_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(upper(line), '{w}') AS INTEGER)" for w in words)


@query(_LINES_SQL + f"""
, s AS (SELECT CASE WHEN length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) >= 12 THEN {_hits_sql(T.HEADER_HINTS)} ELSE 0 END AS header, {_hits_sql(T.ANCHORS)} AS anchors, {_hits_sql(discover.COLUMN_HINTS)} AS columns FROM l)
SELECT header, anchors >= 2 AS anchored, columns, count(*) AS n FROM s GROUP BY 1, 2, 3
""")
def line_vocabulary(spark, sf_dir):
    """Lines by how many words of each vocabulary they hold."""
    line = F.col("line")
    rows = _lines(spark, sf_dir).select(T.header_score(line).alias("header"), T.has_anchors(line).alias("anchored"), T.count_in(line, discover.COLUMN_HINTS).alias("columns"))
    return rows.groupBy("header", "anchored", "columns").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT l_orderkey k, l_linenumber n, repeat(' ', CAST(l_linenumber AS INTEGER) * 3) || 'QTY' || repeat(' ', CAST(l_quantity AS INTEGER)) || 'TOTAL' AS line FROM lineitem)
SELECT k, n, ((instr(line, 'QTY') - 1) // 5 * 5) || ',' || ((instr(line, 'TOTAL') - 1) // 5 * 5) AS places FROM x WHERE (instr(line, 'QTY') - 1) // 5 <> (instr(line, 'TOTAL') - 1) // 5
""")
def column_buckets(spark, sf_dir):
    line = F.concat(F.expr("repeat(' ', int(l_linenumber) * 3)"), F.lit("QTY"), F.expr("repeat(' ', int(l_quantity))"), F.lit("TOTAL"))
    placed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), T.buckets(line).alias("b")).where(F.size("b") > 1)
    return placed.select("k", "n", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("places"))


# ---- the rest of the operators, each on its own


@query("""
WITH h AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS nth FROM h WHERE g > 0)
SELECT conv_id, min(turn) AS turn, sha256(string_agg(text, ' ' ORDER BY turn)) AS folded, count(*) AS n_lines FROM r WHERE nth <= 2 GROUP BY conv_id, g
""")
def fold_first_continuation(spark, sf_dir):
    out = folds.fold_wrapped(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "text", first_only=True)
    return out.select("conv_id", "at.turn", F.sha2(F.col("text").cast("binary"), 256).alias("folded"), "n_lines")


_WORDS_OF_TEXT = "coalesce(list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z#/]{2,}'), lambda x: upper(x)))), 'string_agg', ','), '')"


@query(f"""
WITH s AS (SELECT doc_id, substring(sha256(source || '|' || {_WORDS_OF_TEXT}), 1, 16) AS signature FROM documents)
SELECT signature, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS documents FROM s GROUP BY 1
""")
def signature_clusters(spark, sf_dir):
    """Documents of one source and vocabulary, over whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("source"), F.coalesce("text", F.lit(""))).alias("signature"))
    return profiles.clusters(docs).select("signature", "n", F.array_join(F.transform("documents", lambda d: d.cast("string")), ",").alias("documents"))


@query(_LINES_SQL + "SELECT doc_id, 'p1:' || max(line_no) AS place FROM l GROUP BY 1")
def row_locations(spark, sf_dir):
    last = _lines(spark, sf_dir).groupBy("doc_id").agg(F.max(F.struct("page", "line_no")).alias("at"))
    return last.select("doc_id", rules.location(F.col("at.page"), F.col("at.line_no")).alias("place"))


_REASON_SQL = f"""
t AS (SELECT doc_id, coalesce(text, '') AS x, CAST(length(replace(replace(coalesce(text, ''), ' ', ''), chr(9), '')) AS DOUBLE) AS chars FROM documents),
j AS (SELECT doc_id, x, chars, ({" + ".join(f"CAST(contains(upper(x), '{w}') AS INTEGER)" for w in T.ANCHORS)}) >= 2 AS anchors, {" OR ".join(f"regexp_matches(x, '{p}')" for p in T.ANNOTATIONS)} AS signs FROM t),
w AS (SELECT doc_id, x, chars, CASE WHEN regexp_matches(x, '\S') AND NOT anchors AND (signs OR chars < {T.UNANCHORED}) THEN 'annotation-only text layer' WHEN chars < {T.READABLE} THEN 'no usable text layer' WHEN NOT anchors THEN 'no invoice vocabulary' END AS reason FROM j)
"""


def _layers(spark, sf_dir) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), T.density(text).cast("double").alias("chars_per_page"))


@query("WITH " + _REASON_SQL + "SELECT doc_id, reason FROM w")
def usable_text(spark, sf_dir):
    return _layers(spark, sf_dir).select("doc_id", D.unusable_reason(F.col("text"), F.col("chars_per_page")).alias("reason"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 = 0")
def usable_documents(spark, sf_dir):
    """Of three kinds of documents, told line by line: an invoice, one that is nearly empty, and a dense one without any of its words."""
    kind = F.col("o_orderkey") % 3
    texts = [F.when(kind == 2, "a letter").otherwise("INVOICE"), F.when(kind == 1, "x").otherwise(F.expr("repeat('many words ', 40)")), F.when(kind == 2, "so long").otherwise("balance due")]
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    return discover.usable_documents(lines)


@query("""
SELECT o_orderkey AS doc_id, s.strategy, a.aggregate, 'grand total' AS total_label, CAST(o_totalprice AS DECIMAL(18,2)) AS computed, CAST(1 AS BIGINT) AS n_rows
FROM orders, (VALUES ('starred')) s(strategy), (VALUES ('first_money')) a(aggregate) WHERE o_totalprice <> 1 AND o_totalprice <> 2
""")
def search_with_own_tables(spark, sf_dir):
    """A selector and an aggregate of the caller's: starred rows, their first amounts."""
    shown = F.format_number(F.col("o_totalprice").cast(AMOUNT), 2)
    texts = [F.concat(F.lit("* row "), shown, F.lit("  1.00")), F.lit("  other  2.00"), F.concat(F.lit("Grand Total  "), shown)]
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    found = discover.search(lines, discover.total_candidates(lines), {"starred": lambda line, amounts: line.startswith("*")}, {"first_money": lambda amounts: F.get(amounts, F.lit(0))})
    return found.where("strategy = 'starred' and aggregate = 'first_money'").select("doc_id", "strategy", "aggregate", "total_label", "computed", "n_rows")


@query("WITH " + _REASON_SQL + """
SELECT doc_id, sha256(CASE WHEN reason IS NOT NULL AND doc_id % 3 = 0 THEN 'INVOICE TOTAL ' || repeat('word ', 99) || x ELSE x END) AS text,
  CASE WHEN reason IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN reason || '; recognition failed: engine' ELSE reason || '; recognition failed: not tried' END AS reason FROM w
""")
def load_with_escalation(spark, sf_dir):
    """Text layers, then recognised texts of a third, failures of another; the last third was not tried."""
    first = _layers(spark, sf_dir)
    good = F.concat(F.lit("INVOICE TOTAL "), F.expr("repeat('word ', 99)"), F.col("text"))
    second = first.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, good).alias("text"), F.lit(500.0).alias("chars_per_page"), F.when(F.col("doc_id") % 3 == 1, "engine").alias("error"))
    return D.escalate(first, second).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"), "reason")


@query("""
WITH o AS (SELECT o_orderkey k, CAST(o_totalprice AS DECIMAL(18,2)) v FROM orders)
SELECT k AS doc_id, x.label, x.priority, CAST(x.v AS DECIMAL(18,2)) AS value FROM o, LATERAL (SELECT * FROM (VALUES ('grand total', 1, v), ('sub total', 2, v - 1.00), ('balance due', 3, v)) y(label, priority, v)) x
""")
def total_labels_ranked(spark, sf_dir):
    """Printed totals by label: the likeliest first; balances of the account and labels right of their amounts are none."""
    v = F.col("o_totalprice").cast(AMOUNT)
    shown = lambda c: F.format_number(c.cast(AMOUNT), 2)
    texts = [F.concat(F.lit("Grand   Total  $"), shown(v)), F.concat(F.lit("Sub Total  "), shown(v - 1)), F.concat(F.lit("Balance Due: $"), shown(v)), F.concat(F.lit("Account Balance Total $"), shown(v)), F.concat(F.lit("$"), shown(v), F.lit("  invoice total"))]
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    return discover.total_candidates(lines).select("doc_id", "label", "priority", "value")


@query("SELECT o_orderkey AS doc_id, x.marker, CAST(x.line_no AS INTEGER) AS line_no FROM orders, LATERAL (SELECT * FROM (VALUES ('Detail of charges', 0), ('Summary', 2), ('by county type', 4), ('programs ' || o_orderkey, 5)) y(marker, line_no)) x")
def restatement_markers(spark, sf_dir):
    """Short lines that announce a copy of the charges: each once, none with an amount, none too long."""
    texts = [F.lit("Detail of charges"), F.concat(F.lit("Summary $"), F.format_number(F.col("o_totalprice").cast(AMOUNT), 2)), F.lit("  Summary "), F.lit("Summary"), F.lit("by county type"), F.concat(F.lit("programs "), F.col("o_orderkey")), F.concat(F.lit("recap "), F.expr("repeat('x', 60)"))]
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    return discover.markers(lines).select("doc_id", "marker", "at.line_no")


@query(_LINES_SQL + f"""
, s AS (SELECT doc_id, line_no, regexp_replace(line, '\s+$', '') AS line, {_hits_sql(discover.COLUMN_HINTS)} AS score FROM l)
SELECT line, max(score) AS score FROM s WHERE score >= 2 GROUP BY 1 ORDER BY 2 DESC, min((doc_id, line_no)) LIMIT 8
""")
def header_candidate_lines(spark, sf_dir):
    return discover.header_candidates(_lines(spark, sf_dir))


@query(_VERSIONS_SQL + "SELECT DISTINCT identity FROM v WHERE trim(identity) <> '' AND (seq % 3 = 0 OR seq % 5 = 0)")
def identities_known(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return D.known_identities(v.where("seq % 3 = 0"), v.where("seq % 5 = 0"))


@query(_ARMS_SQL + """
, d AS (SELECT s, max(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) depth, count(*) FILTER (WHERE status <> 'pass') bad FROM r GROUP BY s)
SELECT count(*) AS n, count(*) FILTER (WHERE depth = 1 AND bad = 0) AS verified, count(*) FILTER (WHERE depth = 1 AND bad = 0) AS shallow, 7 AS recognised, CAST(0 AS BIGINT) AS advisory FROM d
""")
def run_totals(spark, sf_dir):
    rows = _arms(spark, sf_dir)
    results = ladder.reconcile(rows, _ARM_CHECKS)
    return sinks.run_summary(ladder.verdicts(rows, results), results, recognised=7).drop("computed_total")


@query(_ARMS_SQL + """
, d AS (SELECT s, max(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) depth, count(*) FILTER (WHERE status <> 'pass') bad FROM r GROUP BY s), f AS (SELECT s FROM d WHERE depth = 0 OR bad > 0)
SELECT CAST(lpad(CAST(s AS VARCHAR), 9, '0') AS VARCHAR) AS identity, (SELECT count(*) FROM d) AS records, (SELECT count(*) FROM f) AS flagged FROM f ORDER BY 1 LIMIT 20
""")
def folder_flags(spark, sf_dir):
    """What a folder's report says: counts, and the first flagged records by identity."""
    rows = _arms(spark, sf_dir)
    verdicts = ladder.verdicts(rows, ladder.reconcile(rows, _ARM_CHECKS)).select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("identity"), "verified")
    counts, flagged = sinks.folder_status(table(spark, sf_dir, "supplier"), verdicts)
    return flagged.select("identity").crossJoin(F.broadcast(counts.select("records", "flagged")))  # one row


@query(_LINES_SQL + r"""
, f AS (SELECT doc_id, line_no, line, lead(line, 2) OVER w AS second FROM l WHERE regexp_matches(line, '\S') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT doc_id, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS raw FROM l)
SELECT doc_id, a.second, b.raw FROM (SELECT doc_id, CAST(coalesce(sum(length(second)), 0) AS BIGINT) AS second FROM f GROUP BY 1) a JOIN (SELECT doc_id, CAST(coalesce(sum(length(raw)), 0) AS BIGINT) AS raw FROM r GROUP BY 1) b USING (doc_id)
""")
def looks_along_lines(spark, sf_dir):
    """The second non-blank line further down, and the line above as it stands."""
    lines = _lines(spark, sf_dir)
    second = lines.where(~T.is_blank(F.col("line"))).withColumn("x", folds.filled(F.col("line"), steps=2)).groupBy("doc_id").agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).cast("long").alias("second"))
    raw = lines.withColumn("x", folds.raw_line(F.col("line"), steps=-1)).groupBy("doc_id").agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).cast("long").alias("raw"))
    return second.join(raw, "doc_id")


@query("""
WITH e AS (SELECT *, event_id // 50 AS page FROM events), a AS (SELECT event_id, page, last_value(CASE WHEN event_type = 'purchase' THEN {'p': page, 'v': CAST(value AS DECIMAL(18,2))} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM e)
SELECT event_id, CASE WHEN x.p = page THEN x.v END AS v FROM a
""")
def asof_on_page(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("page", F.floor(F.col("event_id") / 50).cast("int"))
    return ev.select("event_id", folds.last_of_on_page(["purchase"], F.col("v"), folds.ordered(["doc_id"], ["line_no"]), "line").alias("v"))


@query("""
WITH d AS (SELECT lang || '/' || n_chars % 9 AS signature, source AS spec, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS bound_at, doc_id FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL),
a AS (SELECT signature, arg_min(spec, bound_at) AS spec, min(bound_at) AS bound_at FROM d WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT signature, arg_min(spec, bound_at) AS spec, min(bound_at) AS bound_at FROM d WHERE doc_id % 2 = 1 AND signature NOT IN (SELECT signature FROM a) GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def bindings_upserted(spark, sf_dir):
    """Bindings of two runs: what the first bound stays, the second adds what is new."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null")
    seen = docs.select(F.concat("lang", F.lit("/"), (F.col("n_chars") % 9).cast("string")).alias("signature"), F.col("source").alias("spec"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("bound_at"), F.lit("").alias("notes"), "doc_id")
    first = state.bind(seen.drop("doc_id").limit(0), seen.where("doc_id % 2 = 0").drop("doc_id"))
    return state.bind(first, seen.where("doc_id % 2 = 1").drop("doc_id")).drop("notes")


@query("SELECT o_orderkey AS k, o_orderstatus AS status, 'a: ' || o_orderkey AS title, CAST(2 AS INTEGER) AS n FROM orders")
def metadata_map(spark, sf_dir):
    """Lines of key and value: parted at the first colon, the later of equal keys wins."""
    text = F.concat(F.lit("Status: no\nnothing\nTitle:  a: "), F.col("o_orderkey"), F.lit("\nStatus:"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), D.parse_metadata(text).alias("m")).select("k", F.col("m")["Status"].alias("status"), F.col("m")["Title"].alias("title"), F.size("m").alias("n"))


@query("SELECT l_suppkey AS s, count(*) AS rows, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS bound FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0")
def bound_to_another_layout(spark, sf_dir):
    """Documents (items) whose signature (flag) is bound to another rule set than the one of this run."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("signature"))
    bindings = items.select("signature").distinct().withColumn("spec", F.when(F.col("signature") == "R", "other").otherwise("own"))
    elsewhere = state.bound_elsewhere(items, bindings, "own").groupBy("s").agg(F.count(F.lit(1)).alias("bound"))
    return elsewhere.join(items.groupBy("s").agg(F.count(F.lit(1)).alias("rows")), "s")
