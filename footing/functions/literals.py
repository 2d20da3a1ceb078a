"""What a line must hold for a pattern to match it: a cheap test before an expensive one.

``required`` reads a pattern's structure and gives strings of which every match contains at least one.
:class:`Prefilter` looks for the strings of many patterns once a line and keeps the answers as bits,
so that a pattern runs only on lines that hold what it requires.  No answer changes: where nothing can be
said about a pattern, it always runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: More alternatives than this are not worth looking for.
MOST = 6
_REPEATS = {C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT}


def required(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of the pattern contains one; empty if there are none to tell."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):  # what only the engine's own dialect has
        return ()
    if tree.state.flags & re.IGNORECASE:
        return ()
    found = _of(tree)
    return tuple(sorted(found)) if len(found) <= MOST else ()


def _better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    """The more telling of two sets: its shortest string is longer, or it is smaller."""
    if not a or not b:
        return a or b
    rank = lambda x: (min(map(len, x)), -len(x))
    return max(a, b, key=rank)


def _of(sequence: Iterable) -> frozenset[str]:
    best, run = frozenset(), ""
    for what, value in [*sequence, (None, None)]:
        if what is C.LITERAL:
            run += chr(value)
            continue
        if run:
            best = _better(best, frozenset({run}))
            run = ""
        if what is C.SUBPATTERN:
            own = _of(value[3]) if not value[1] & re.IGNORECASE else frozenset()
        elif what is C.ATOMIC_GROUP:
            own = _of(value)
        elif what in _REPEATS:
            own = _of(value[2]) if value[0] > 0 else frozenset()
        elif what is C.BRANCH:
            each = [_of(branch) for branch in value[1]]
            own = frozenset().union(*each) if all(each) else frozenset()
        else:
            own = frozenset()
        best = _better(best, own)
    return best


class Prefilter:
    """Bits of the strings that patterns require, in as many long columns as it takes."""

    BITS = 63

    def __init__(self, patterns: Iterable[str], name: str = "literals") -> None:
        self.needs = {p: required(p) for p in patterns}
        self.strings = sorted({x for own in self.needs.values() for x in own})
        self.name = name

    def columns(self, line: Column) -> dict[str, Column]:
        """The bit columns to add to lines."""
        out = {}
        for k in range(0, len(self.strings), self.BITS):
            bits = F.lit(0).cast("long")
            for n, x in enumerate(self.strings[k : k + self.BITS]):
                bits = bits.bitwiseOR(F.when(F.contains(line, F.lit(x)), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
            out[f"{self.name}{k // self.BITS}"] = bits
        return out

    def may(self, pattern: str) -> Column | None:
        """Whether a line may match, from the bit columns; None if it always may."""
        masks: dict[int, int] = {}
        for x in self.needs.get(pattern, ()):
            k = self.strings.index(x)
            masks[k // self.BITS] = masks.get(k // self.BITS, 0) | 1 << k % self.BITS
        out = None
        for k, mask in masks.items():
            hit = F.col(f"{self.name}{k}").bitwiseAND(F.lit(mask).cast("long")) != 0
            out = hit if out is None else out | hit
        return out

    def match(self, line: Column, pattern: str) -> Column:
        """The line matches: the pattern runs where it may."""
        may = self.may(pattern)
        return line.rlike(pattern) if may is None else may & line.rlike(pattern)
