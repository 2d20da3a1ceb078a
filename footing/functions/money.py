"""Exact amounts in text, as native expressions.

An amount has a decimal part; "no amount" is NULL and never zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"
#: Letters and signs that a scan prints for a one.
ONE_LIKE = "lLiI|!"


def amount_pattern(min_decimals: int = 2) -> str:
    """The grammar of one amount token.

    Groups: 1 open bracket, 2 and 3 minus before and after the currency, 4 digits with
    separators, 5 minus at the end, 6 close bracket.
    """
    places = r"[0-9]{2}" if min_decimals >= 2 else r"[0-9]{1,2}"
    digits = rf"[0-9]{{1,3}}(?:[,. ][0-9]{{3}})*[,.]{places}|[0-9]+[,.]{places}"
    return rf"^(\()?\s*(-)?\s*(?:[$€£]|USD\s*)?\s*(-)?({digits})(-)?\s*(\))?$"


def _plain(digits: Column) -> Column:
    """Digits with one point: the rightmost separator is the decimal one.

    A comma alone is decimal only before exactly two digits; else it parts thousands.
    """
    text = F.replace(digits, F.lit(" "), F.lit(""))
    tail = F.regexp_extract(text, r"([0-9]*)$", 1)
    mark = F.substring(text, F.length(text) - F.length(tail), F.lit(1))
    whole = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 1), "[,.]", "")
    only_commas = ~text.contains(".")
    joined = F.regexp_replace(text, ",", "")
    return F.when(only_commas & (mark == ",") & (F.length(tail) != 2), joined).otherwise(F.concat(whole, F.lit("."), tail))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of any script (the Unicode property), which :func:`strip` takes off.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(F.trim(text), F.lit(WHITE))  # plain blanks first: taking those off is cheap


#: What nearly all amounts look like; their commas are taken out and they are numbers.
_COMMON = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\.[0-9]{2}$"


def plain_money(text: Column) -> Column:
    """The amount where the text has the common form and nothing else; NULL elsewhere."""
    return F.when(text.rlike(_COMMON), F.translate(text, ",", "").try_cast(AMOUNT))


def parse_money(token: Column, lenient: bool = False, min_decimals: int = 2) -> Column:
    """decimal(18,2), or NULL where the token is not one amount.

    ``lenient`` reads look-alikes of 1 in scanned text; ``min_decimals=1`` also takes a
    single decimal.  A minus anywhere makes it negative, or a pair of brackets; one
    bracket does not.
    """
    pattern = amount_pattern(min_decimals)

    def read(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, pattern, k)
        value = let(part(4), lambda digits: _plain(digits).try_cast(AMOUNT))
        minus = (part(2) != "") | (part(3) != "") | (part(5) != "") | ((part(1) != "") & (part(6) != ""))
        signed = let(value, lambda v: F.when(minus, (-v).cast(AMOUNT)).otherwise(v))
        return F.when(text.rlike(_COMMON), plain_money(text)).when(text.rlike(pattern), signed)

    return let(F.translate(strip(token), ONE_LIKE, "1" * len(ONE_LIKE)) if lenient else strip(token), read)


def looks_like_money(token: Column, lenient: bool = False, min_decimals: int = 2) -> Column:
    return parse_money(token, lenient, min_decimals).isNotNull()


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda x: x != "")


def money_tokens(line: Column, lenient: bool = False, min_decimals: int = 2) -> Column:
    """array<struct<raw,value,idx,start,end>>: every amount of a line, left to right.

    idx counts the line's words from 0; start and end are character offsets.
    """
    words = _words(line)
    first = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<raw:string,idx:int,start:int,end:int>>))")

    def step(acc: Column, word: Column) -> Column:
        start = F.position(word, line, acc["at"] + 1) - 1
        end = start + F.length(word)
        item = F.struct(word.alias("raw"), F.size(acc["out"]).alias("idx"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    placed = F.aggregate(words, first, step, lambda acc: acc["out"])
    hits = F.transform(placed, lambda x: F.struct(x["raw"].alias("raw"), parse_money(x["raw"], lenient, min_decimals).alias("value"), x["idx"].alias("idx"), x["start"].alias("start"), x["end"].alias("end")))
    return F.filter(hits, lambda x: x["value"].isNotNull())


def amounts(line: Column, lenient: bool = False, min_decimals: int = 2) -> Column:
    """array<decimal(18,2)>: the amounts of a line without their places."""
    words = _words(line)
    if not lenient:  # a mark between digits is what no amount lacks
        words = F.when(line.rlike("[0-9][.,][0-9]"), F.filter(words, lambda x: x.rlike("[0-9][.,][0-9]"))).when(line.isNotNull(), F.array().cast("array<string>"))
    return F.filter(F.transform(words, lambda x: parse_money(x, lenient, min_decimals)), lambda x: x.isNotNull())


def last_money(line: Column, lenient: bool = False, min_decimals: int = 2) -> Column:
    """The rightmost amount, NULL if there is none."""
    return F.try_element_at(amounts(line, lenient, min_decimals), F.lit(-1))


def sum_money(line: Column) -> Column:
    """Sum of all amounts; a line without any counts 0.00 here."""
    return F.aggregate(amounts(line), F.lit(0).cast(AMOUNT), lambda a, x: (a + x).cast(AMOUNT))


def decimal_field(text: Column) -> Column:
    """A field's number: commas and dollar signs taken off, NULL where no number is left.

    More than two decimals would be rounded by a cast; such a field is NULL.
    """
    number = r"^[+-]?([0-9]+(\.[0-9]{0,2})?|\.[0-9]{1,2})$"
    return let(strip(F.translate(text, ",$", "")), lambda bare: F.when(bare.rlike(number), bare.try_cast(AMOUNT)))


def credit(value: Column, text: Column) -> Column:
    """The value, negative where the text marks a credit: CR at its end, or brackets around it."""
    marked = text.rlike(r"(?i)(\bCR|\))\s*$")
    return F.when(marked & (value > 0), (-value).cast(AMOUNT)).otherwise(value)
