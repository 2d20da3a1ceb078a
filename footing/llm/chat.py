"""Chat formatting in budgeted windows, in DataFrame operations only.

Every conversation becomes one or more windows of at most ``budget`` tokens.  Prefix sums
of turn tokens choose spans of whole turns; each window repeats the system turn and up to
``history`` turns before its span, and the loss mask covers only the assistant texts of
the span, so that no text is a target twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Marks of the template.
START = "<|im_start|>"
END = "<|im_end|>"

#: Tokens that a turn's marks and role cost.
TURN_COST = 5


def escape(text: Column) -> Column:
    """A backslash more between "<" and "|": no text holds a mark, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def count_tokens(text: Column) -> Column:
    """Words and single marks, a stand-in for a tokenizer that needs no Python."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]")).cast("long")


def format_windows(
    turns: DataFrame,
    budget: int = 512,
    history: int = 2,
    history_budget: int = 128,
    tokens: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """Windows of all conversations.

    ``turns`` has conv_id, turn, role, text.  Turns go by (turn, role, text), nulls first;
    null roles and texts count as empty, rows of a null conv_id form one conversation, and
    repeated rows stay.  A first turn of role "system" stands in every window.  A turn
    longer than the budget has a window of its own, uncut and without history.

    Returns conv_id, window (from 0), text, n_repeated (leading turns that earlier windows
    have as well), n_tokens, loss (array of start and end, in code points of text).
    """
    raw = turns.select("conv_id", F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cost = raw.withColumn("tok", tokens(F.col("text")) + F.lit(TURN_COST))
    order = Window.partitionBy("conv_id").orderBy("t", "role", "text")
    rows = cost.withColumn("idx", F.row_number().over(order) - 1).withColumn("pre", F.coalesce(F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("sys", (F.col("idx") == 0) & (F.col("role") == "system"))
    # turns before this one that fit the history budget, nearest first
    n, spent, going = F.lit(0), F.lit(0).cast("long"), F.lit(True)
    for k in range(1, history + 1):
        back = F.lag("tok", k).over(order)
        going = going & back.isNotNull() & ~F.coalesce(F.lag("sys", k).over(order), F.lit(True)) & (spent + F.coalesce(back, F.lit(0)) <= history_budget)
        rows = rows.withColumn(f"_go{k}", going)
        going = F.col(f"_go{k}")
        n, spent = n + going.cast("int"), spent + F.when(going, back).otherwise(0)
    rows = rows.withColumn("hist_n", n).withColumn("hist_tok", spent)
    shown = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", shown).withColumn("body", escape(F.col("text"))).withColumn("target", F.col("role") == "assistant")
    convs = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "tok", "pre", "hist_n", "hist_tok", "sys", "target", "head", "body"))).alias("turns")
    )
    convs = convs.withColumn("systok", F.when(F.col("turns")[0]["sys"], F.col("turns")[0]["tok"]).otherwise(F.lit(0).cast("long")))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(budget) - F.col("systok")
        over = acc["hist"] + x["pre"] + x["tok"] - acc["base"] > room
        keep = x["hist_tok"] + x["tok"] <= room  # history only where the first turn still fits
        fresh = F.struct(x["idx"].alias("at"), F.when(keep, x["hist_n"]).otherwise(0).alias("hist_n"))
        # a span never starts within the system turn: that one opens the first span
        cut = F.size(acc["cuts"]) == 0
        return F.struct(
            F.when(cut | over, x["pre"]).otherwise(acc["base"]).alias("base"),
            F.when(cut | over, F.when(keep, x["hist_tok"]).otherwise(F.lit(0).cast("long"))).otherwise(acc["hist"]).alias("hist"),
            F.when(cut | over, F.concat(acc["cuts"], F.array(fresh))).otherwise(acc["cuts"]).alias("cuts"),
        )

    zero = F.expr("named_struct('base', 0L, 'hist', 0L, 'cuts', cast(array() as array<struct<at:int,hist_n:int>>))")
    body = F.filter("turns", lambda x: ~x["sys"])
    # a conversation of a system turn alone still has its window
    walked = F.when(F.size(body) > 0, body).otherwise(F.col("turns"))
    convs = convs.withColumn("walked", walked).withColumn("cuts", F.aggregate("walked", zero, step)["cuts"])
    ends = F.transform("cuts", lambda c, i: F.struct(c["at"].alias("at"), c["hist_n"].alias("hist_n"), F.coalesce(F.get("cuts", i + 1)["at"], F.size("turns")).alias("to")))
    spans = convs.select("conv_id", "turns", F.posexplode(ends).alias("window", "span"))
    at, to, has_sys = F.col("span.at"), F.col("span.to"), F.col("turns")[0]["sys"]
    first = F.when(has_sys & (at > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", at + 1, to - at)
    past = F.slice("turns", at - F.col("span.hist_n") + 1, F.col("span.hist_n"))
    # the first window holds the system turn as its own
    repeated = F.when(F.col("window") == 0, F.lit(0)).otherwise(F.size(first)) + F.col("span.hist_n")
    parts = spans.select("conv_id", "window", repeated.alias("n_repeated"), F.concat(first, past, own).alias("parts"))
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END), F.lit("\n"))
    text = F.array_join(F.transform("parts", whole), "")
    tok = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tok"])
    marks = F.transform("parts", lambda x, i: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), (x["target"] & (i >= F.col("n_repeated"))).alias("on")))
    start = F.expr("named_struct('pos', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")

    def mark(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["h"]
        e = s + x["b"]
        return F.struct(
            (e + F.lit(len(END) + 1)).alias("pos"),
            F.when(x["on"], F.concat(acc["spans"], F.array(F.struct(s.alias("start"), e.alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    return parts.select("conv_id", "window", text.alias("text"), "n_repeated", tok.alias("n_tokens"), F.aggregate(marks, start, mark)["spans"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets as the windows' texts and masks hold them.

    Returns conv_id, turns (array of role, text, without repeats) and targets (array of
    unescaped text under the mask), both in order, and formatted_chars.
    """
    pieces = F.filter(F.split("text", r"<\|im_start\|>", -1), lambda x: x != "")
    parsed = F.transform(
        pieces,
        lambda x: F.struct(
            _unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(x.substr(F.position(F.lit("\n"), x) + 1, F.length(x) - F.position(F.lit("\n"), x) - F.lit(len(END) + 1))).alias("text"),
        ),
    )
    fresh = F.slice(parsed, F.col("n_repeated") + 1, F.size(parsed))
    targets = F.transform("loss", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["end"] - s["start"])))
    each = windows.select("conv_id", "window", fresh.alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))
    group = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return group.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.targets")).alias("targets"), "formatted_chars")
