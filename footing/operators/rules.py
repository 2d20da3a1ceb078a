"""Ordered classification of lines: the first rule that matches names the line.

Rules are declarations; a whole list compiles to one chain of native conditions over window
columns.  Rules whose acceptance depends on how earlier lines were classified (wrapped text,
mostly) declare an :class:`Anchor` and are resolved in further passes, in their order.
:func:`classify_in_order` folds line by line instead; it gives the same answers and serves
rule sets that say ``sequential``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.functions.literals import Prefilter
from footing.functions.money import AMOUNT, decimal_field, last_money, parse_money, plain_money
from footing.functions.text import column_cuts, is_blank, let, strip
from footing.operators.scans import Scan, carried, scan

# What a line can be.
KINDS = (
    "charge", "group_subtotal", "section_subtotal", "invoice_subtotal", "tax", "grand_total", "column_total", "row_count", "adjustment", "net_due",
    "section_header", "column_header", "header_field", "continuation", "restatement", "ignorable", "unclassified",
)
MONEY_KINDS = frozenset({"charge", "group_subtotal", "section_subtotal", "invoice_subtotal", "tax", "grand_total", "column_total", "adjustment", "net_due", "restatement"})
BODY = "body"
BLANK = "blank"
#: Stands for the kind of a row whose rule an anchor names.
NAMED = "@rule"


@dataclass(frozen=True)
class Context:
    """Columns that guards and extractors may use."""

    line: Column
    zone: Column
    next_line: Column
    previous_line: Column
    seen_header: Column
    seen_header_on_page: Column
    header_line: Column
    previous_marker: Column  # name of the zone marker that the last line before this one was, on any page
    cuts: Column  # places and widths of the header's labels (:func:`footing.functions.text.column_cuts`)

    def seen(self, flag: str) -> Column:
        """Whether an earlier line of the document matches the flag's pattern."""
        return F.col(f"flag_{flag}")

    def group(self, number: int) -> Column:
        """A group of the rule's own match, empty where it took no part; for extractors only."""
        return F.get(F.col("_groups"), F.lit(number))

    def amount(self, number: int) -> Column:
        """A group's amount, NULL where it is none; for extractors only."""
        text = self.group(number)
        return F.coalesce(plain_money(text), parse_money(text))


@dataclass(frozen=True)
class Anchor:
    """Accept a line only after a row of ``kinds``, stepping back over rows of ``skip``.

    ``first_only``: a line that would be accepted itself also stops the next one.  ``rules``: rows of
    these rules anchor as well, though their kind is stepped over.  ``through``: lines that
    these anchored rules would accept are stepped over too, for rules that accept under one condition
    and follow each other in any order.
    """

    kinds: frozenset[str]
    skip: frozenset[str] = frozenset()
    first_only: bool = False
    rules: frozenset[str] = frozenset()
    through: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Rule:
    """pattern (searched for, groups by number) or predicate; then zones, guard and anchor.

    fields: name -> group number or expression of the context, for texts; nums the same for
    amounts.  cells: a map of further texts in one expression, for fields that share their work.
    A money kind without an "amount" gets the line's last amount.
    """

    name: str
    kind: str
    pattern: str | None = None
    predicate: Callable[[Column], Column] | None = None
    zones: tuple[str, ...] = ()
    guard: Callable[[Context], Column] | None = None
    anchor: Anchor | None = None
    fields: dict[str, int | Callable[[Context], Column]] = field(default_factory=dict)
    nums: dict[str, int | Callable[[Context], Column]] = field(default_factory=dict)
    cells: Callable[[Context], Column] | None = None

    def __post_init__(self) -> None:
        if (self.pattern is None) == (self.predicate is None):
            raise ValueError(f"{self.name}: either a pattern or a predicate")
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: no kind {self.kind}")


@dataclass(frozen=True)
class Zone:
    """Lines from one that matches on are in this zone, until another marker."""

    name: str
    pattern: str
    zone: str
    kind: str = "section_header"


def with_zones(lines: DataFrame, zones: Sequence[Zone], block: int | None = None) -> DataFrame:
    """Adds marker (the zone marker's number, if the line is one) and zone; never reset at pages."""
    return scan(_marked(lines, zones, None), {"zone": carried(F.col("_zone"))}, block).withColumn("zone", F.coalesce("zone", F.lit(BODY))).drop("_zone")


def _marked(lines: DataFrame, zones: Sequence[Zone], literals: Prefilter | None) -> DataFrame:
    """Adds marker and _zone, the zone that the line opens."""
    chain: Column = F.lit(None).cast("int")
    names = F.lit(None).cast("string")
    for k in reversed(range(len(zones))):
        hit = _match(zones[k].pattern, literals)
        chain, names = F.when(hit, k).otherwise(chain), F.when(F.col("marker") == k, zones[k].zone).otherwise(names)
    return lines.withColumn("marker", chain).withColumn("_zone", names)


def _match(pattern: str, literals: Prefilter | None) -> Column:
    return F.col("line").rlike(pattern) if literals is None else literals.match(F.col("line"), pattern)


def with_context(lines: DataFrame, header: str | None = None, flags: dict[str, str] | None = None, block: int | None = None) -> DataFrame:
    """Adds the neighbouring non-blank lines of the page, the table header before, and the flags."""
    return _scanned(_looked_at(lines, header, flags, (), None), flags or {}, {}, (), block).drop("cuts")


def _looked_at(lines: DataFrame, header: str | None, flags: dict[str, str] | None, labels: Sequence[str], literals: Prefilter | None) -> DataFrame:
    """What each line says by itself: blank, header (with its columns' places), flags."""
    head = _match(header, literals) if header else F.lit(False)
    cuts = column_cuts(F.col("line"), labels) if labels else F.lit(None).cast("array<int>")
    own = {"is_blank": is_blank(F.col("line")), "_is_header": F.coalesce(head, F.lit(False))} | {f"_flag_{k}": _match(p, literals) for k, p in (flags or {}).items()}
    return lines.withColumns(own).withColumns({"_text": F.when(~F.col("is_blank"), F.col("line")), "_head": F.when(F.col("_is_header"), F.struct(F.col("line").alias("line"), cuts.alias("cuts")))})


def _scanned(lines: DataFrame, flags: dict[str, str], more: dict[str, Scan], drop: Sequence[str], block: int | None) -> DataFrame:
    scans = {
        "_header": carried(F.col("_head"), upto=False),
        "seen_header_on_page": Scan("seen", F.col("_is_header"), page=True),
        "previous_line": Scan("last", F.col("_text"), page=True),
        "next_line": Scan("next", F.col("_text"), page=True),
    }
    scans |= {f"flag_{k}": Scan("seen", F.col(f"_flag_{k}")) for k in flags} | more
    out = scan(lines, scans, block).withColumns({"seen_header": F.col("_header").isNotNull(), "header_line": F.col("_header.line"), "cuts": F.col("_header.cuts")})
    return out.drop("_is_header", "_text", "_head", "_header", *[f"_flag_{k}" for k in flags], *drop)


def _context() -> Context:
    return Context(*[F.col(c) for c in ("line", "zone", "next_line", "previous_line", "seen_header", "seen_header_on_page", "header_line", "previous_marker", "cuts")])


def _applies(rule: Rule, literals: Prefilter | None) -> Column:
    ctx = _context()
    hit = F.lit(True)
    if rule.zones:  # what costs least comes first
        hit = hit & ctx.zone.isin(*rule.zones)
    hit = hit & (_match(rule.pattern, literals) if rule.pattern is not None else rule.predicate(ctx.line))
    if rule.guard is not None:
        hit = hit & F.coalesce(rule.guard(ctx), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def _kind_of(number: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.coalesce(F.get(kinds, number), F.lit("unclassified"))


def classify(
    lines: DataFrame, rules: Sequence[Rule], zones: Sequence[Zone] = (), header: str | None = None, blank_is_ignorable: bool = True, flags: dict[str, str] | None = None,
    labels: Sequence[str] = (), block: int | None = None, prefilter: bool = True,
) -> DataFrame:
    """doc_id, page, line_no, raw, zone, kind, rule, fields, nums, row_error of every line.

    Zone markers come first, then blank lines (dropped, or unclassified if not ignorable),
    then the first rule that applies; all else is unclassified.  row_error marks a money
    kind whose amount cannot be read; it concerns that document alone.

    ``labels`` are those of the header whose columns rules cut by (``Context.cuts``).  ``block`` scans long documents
    in blocks (:mod:`footing.operators.scans`), and ``prefilter`` runs a pattern only on lines that hold what it
    requires (:mod:`footing.functions.literals`); neither changes a row.
    """
    literals = Prefilter([z.pattern for z in zones] + [r.pattern for r in rules if r.pattern is not None] + ([header] if header else []) + list((flags or {}).values())) if prefilter else None
    base = lines.select("doc_id", "page", "line_no", "line")
    if literals:
        base = base.withColumns(literals.columns(F.col("line")))
    base = _looked_at(_marked(base, zones, literals), header, flags, labels, literals)
    marks = F.array(*[F.lit(z.name) for z in zones]) if zones else F.array().cast("array<string>")
    more = {"zone": carried(F.col("_zone")), "_last_marker": carried(F.when(~F.col("is_blank"), F.coalesce("marker", F.lit(-1))), upto=False)}
    base = _scanned(base, flags or {}, more, ["_zone"], block)
    base = base.withColumns({"zone": F.coalesce("zone", F.lit(BODY)), "previous_marker": F.when(F.col("_last_marker") >= 0, F.get(marks, F.col("_last_marker")))}).drop("_last_marker")
    plain = [k for k, r in enumerate(rules) if r.anchor is None]
    chain: Column = F.lit(None).cast("int")
    for k in reversed(plain):
        chain = F.when(_applies(rules[k], literals), k).otherwise(chain)
    live = F.col("marker").isNull() & ~F.col("is_blank")
    if blank_is_ignorable:  # no rule meets them and every anchor steps over them
        base = base.where(F.col("marker").isNotNull() | ~F.col("is_blank"))
    rows = base.withColumn("rule_no", F.when(live, chain))
    kind = lambda: F.when(F.col("marker").isNotNull(), F.lit("section_header")).when(F.col("is_blank"), F.lit(BLANK)).otherwise(_kind_of(F.col("rule_no"), rules))
    for k, rule in enumerate(rules):
        if rule.anchor is None:
            continue
        named = [n for n, r in enumerate(rules) if r.name in rule.anchor.rules]
        rows = rows.withColumn("_kind", F.when(F.col("rule_no").isin(named), F.lit(NAMED)).otherwise(kind()) if named else kind())
        anchors = [*rule.anchor.kinds, NAMED]
        wanted = live & _applies(rule, literals) & (F.col("rule_no").isNull() | (F.col("rule_no") > k))
        rows = rows.withColumn("_wanted", wanted)
        skipped = F.col("_kind").isin(BLANK, *rule.anchor.skip)
        for n, r in enumerate(rules):
            if r.name in rule.anchor.through:
                rows = rows.withColumn(f"_through{n}", live & _applies(r, literals) & (F.col("rule_no").isNull() | (F.col("rule_no") >= n)))
                skipped = skipped | F.col(f"_through{n}")
        if rule.anchor.first_only:
            rows = scan(rows, {"_seen": carried(F.when(~skipped | F.col("_wanted"), F.struct("_wanted", "_kind")), upto=False)}, block)
            good = ~F.col("_seen._wanted") & F.col("_seen._kind").isin(*anchors)
        else:
            rows = scan(rows, {"_seen": carried(F.when(~skipped & ~F.col("_wanted"), F.col("_kind")), upto=False)}, block)
            good = F.col("_seen").isin(*anchors)
        rows = rows.withColumn("rule_no", F.when(F.col("_wanted") & F.coalesce(good, F.lit(False)), k).otherwise(F.col("rule_no"))).drop("_seen", "_kind", "_wanted")
    rows = rows.withColumn("kind", kind())
    if zones:
        marked = F.array(*[F.lit(z.kind) for z in zones])
        rows = rows.withColumn("kind", F.when(F.col("marker").isNotNull(), F.get(marked, F.col("marker"))).otherwise(F.col("kind")))
    if not blank_is_ignorable:
        rows = rows.withColumn("kind", F.when(F.col("kind") == BLANK, "unclassified").otherwise(F.col("kind")))
    names = F.array(*[F.lit(r.name) for r in rules])
    rule_name = F.coalesce(F.get(marks, F.col("marker")), F.get(names, F.col("rule_no")))
    fields, nums = _extract(rules)
    rows = _grouped(rows, rules).withColumns({"rule": rule_name, "fields": fields, "nums": nums})
    error = F.col("kind").isin(*MONEY_KINDS) & F.try_element_at("nums", F.lit("amount")).isNull()
    return rows.select("doc_id", "page", "line_no", F.col("line").alias("raw"), "zone", "kind", "rule", "fields", "nums", error.alias("row_error"))


#: Parts the groups of a match.
PART = "\x01"


def _group_count(rule: Rule) -> int:
    try:
        return re.compile(rule.pattern).groups
    except re.error:  # what only the engine's own dialect has
        return max((x for x in [*rule.fields.values(), *rule.nums.values()] if isinstance(x, int)), default=0)


def _grouped(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds _groups and, stripped, _texts: the groups of the match of the rule that claimed the line, by number.

    One run of the pattern finds them all; only a line that holds the parting character itself is read group by group.
    Branches stand in an array: one chain of all of them would be too long a method to be compiled.
    """
    line = F.col("line")
    joined, single = [], []
    for k, rule in enumerate(rules):
        count = _group_count(rule) if rule.pattern is not None and (rule.fields or rule.nums or rule.cells) else 0
        if count:
            mine, numbers = F.col("rule_no") == k, range(1, count + 1)
            joined.append(F.when(mine, F.regexp_replace(line, rule.pattern, PART + "".join(f"${n}{PART}" for n in numbers))))
            single.append(F.when(mine, F.array(F.lit(""), *[F.regexp_extract(line, rule.pattern, n) for n in numbers])))
    if not joined:
        none = F.lit(None).cast("array<string>")
        return rows.withColumns({"_groups": none, "_texts": none})
    first = lambda branches: F.get(F.array_compact(F.array(*branches)), F.lit(0))
    odd = F.contains(line, F.lit(PART))
    out = rows.withColumns({"_joined": F.when(~odd, first(joined)), "_single": F.when(odd, first(single))})
    groups = F.coalesce(F.split("_joined", PART), "_single")
    return out.withColumns({"_groups": groups, "_texts": F.transform(groups, strip)})


def _value(what: int | Callable[[Context], Column]) -> Column:
    if callable(what):
        return what(_context())
    return F.nullif(F.get(F.col("_texts"), F.lit(what)), F.lit(""))


def _number(what: int | Callable[[Context], Column]) -> Column:
    if callable(what):
        return what(_context())
    text = F.get(F.col("_texts"), F.lit(what))
    return F.coalesce(plain_money(text), let(text, lambda x: F.coalesce(parse_money(x), decimal_field(x))))


def _extract(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Maps of texts and of amounts by the rule that claimed the line; absent values have no key."""
    texts: Column = F.expr("cast(map() as map<string,string>)")
    numbers: Column = F.expr(f"cast(map() as map<string,{AMOUNT}>)")
    filled = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    for k in reversed(range(len(rules))):
        rule, mine = rules[k], F.col("rule_no") == k
        own = []
        if rule.fields:
            own.append(F.create_map(*[x for name, what in rule.fields.items() for x in (F.lit(name), _value(what).cast("string"))]))
        if rule.cells is not None:
            own.append(rule.cells(_context()))
        if own:
            texts = F.when(mine, filled(F.map_concat(*own) if len(own) > 1 else own[0])).otherwise(texts)
        nums = dict(rule.nums)
        if rule.kind in MONEY_KINDS and "amount" not in nums:
            nums["amount"] = lambda ctx: last_money(ctx.line)
        if nums:
            pairs = [x for name, what in nums.items() for x in (F.lit(name), _number(what).cast(AMOUNT))]
            numbers = F.when(mine, filled(F.create_map(*pairs))).otherwise(numbers)
    return texts, numbers


def classify_in_order(
    lines: DataFrame, rules: Sequence[Rule], zones: Sequence[Zone] = (), guards: dict[str, Callable[[dict], bool]] | None = None, header: str | None = None, flags: dict[str, str] | None = None,
    block: int | None = None,
) -> DataFrame:
    """doc_id, page, line_no, kind, rule by one fold over each document's lines.

    Each line sees how all before it were classified.  Which rules its own text, its zone, its neighbours and
    native guards allow is found natively for all lines; the fold gets numbers of rules only, and chooses.  It is
    linear: each anchored rule remembers the last kind that matters to it.  ``guards``: rule name -> function of {line, zone,
    next_line, previous_line, kinds}; kinds are those of the document's lines so far.  Such guards need the lines
    themselves in the fold.  Rules must not have ``through`` anchors.
    """
    if any(r.anchor is not None and r.anchor.through for r in rules):
        raise ValueError("anchors that reach through other rules are for classify()")
    tests = guards or {}
    literals = Prefilter([z.pattern for z in zones] + [r.pattern for r in rules if r.pattern is not None])
    own = lines.select("doc_id", "page", "line_no", "line").withColumns(literals.columns(F.col("line")))
    more = {"zone": carried(F.col("_zone")), "_last_marker": carried(F.when(~F.col("is_blank"), F.coalesce("marker", F.lit(-1))), upto=False)}
    base = _scanned(_looked_at(_marked(own, zones, literals), header, flags, (), literals), flags or {}, more, ["_zone"], block)
    marks = F.array(*[F.lit(z.name) for z in zones]) if zones else F.array().cast("array<string>")
    base = base.withColumns({"zone": F.coalesce("zone", F.lit(BODY)), "previous_marker": F.when(F.col("_last_marker") >= 0, F.get(marks, F.col("_last_marker")))})
    allowed = F.array_compact(F.array(*[F.when(_applies(r, literals), F.lit(k)) for k, r in enumerate(rules)]))
    texts = ["line", "zone", "previous_line", "next_line"] if tests else []
    given = base.where(~F.col("is_blank")).select("doc_id", "page", "line_no", F.coalesce("marker", F.lit(-1)).alias("marker"), F.when(F.col("marker").isNull(), allowed).otherwise(F.array().cast("array<int>")).alias("allowed"), *texts)
    anchored = [k for k, r in enumerate(rules) if r.anchor is not None]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("page", "ascending"), ("line_no", "ascending")])
        markers, choices = table.column("marker").to_pylist(), table.column("allowed").to_pylist()
        states = table.select(texts).to_pylist() if tests else None
        last: dict[int, str | None] = dict.fromkeys(anchored)
        kinds: list[str] = []
        names: list[str | None] = []
        for n, (marker, ways) in enumerate(zip(markers, choices)):
            hit = None
            for k in ways:
                if rules[k].name in tests and not tests[rules[k].name](states[n] | {"kinds": kinds}):
                    continue
                if k in last and last[k] not in rules[k].anchor.kinds and last[k] != NAMED:
                    continue
                hit = k
                break
            kinds.append(zones[marker].kind if marker >= 0 else rules[hit].kind if hit is not None else "unclassified")
            names.append(zones[marker].name if marker >= 0 else rules[hit].name if hit is not None else None)
            for k in anchored:
                anchor = rules[k].anchor
                if names[-1] in anchor.rules:
                    last[k] = NAMED
                elif kinds[-1] not in anchor.skip or (anchor.first_only and hit == k):
                    last[k] = kinds[-1]
        return table.select(["doc_id", "page", "line_no"]).append_column("kind", pa.array(kinds, pa.string())).append_column("rule", pa.array(names, pa.string()))

    types = [f"{f.name} {f.dataType.simpleString()}" for f in given.select("doc_id", "page", "line_no").schema]
    return given.groupBy("doc_id").applyInArrow(fold, ", ".join([*types, "kind string", "rule string"]))


def kind_counts(rows: DataFrame) -> DataFrame:
    """kind, n, the most frequent first."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def location(page: Column, line_no: Column) -> Column:
    return F.format_string("p%d:%d", page, line_no)
