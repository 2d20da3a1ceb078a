"""Toxicity by a noisy channel: deobfuscate words under a character model, then score them.

A written word is taken for a plain one sent through a channel that swaps letters for
look-alike signs, repeats letters, and puts signs or spaces between them.  Every sign has
its possible letters, and a sign or space between letters may be a word's end, which makes a
lattice; Viterbi decoding under a character trigram model of the corpus picks the likeliest
plain word.  What words a spelled-out run holds is decoded under the words of the labelled
rows, and the character model for others.  Words and restored words are then
looked up in weights learned from labelled rows: whole words and beginnings of words that
occur in toxic rows far more often than chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import durable, fold, text_bytes
from footing.llm.words import WordIndex, drop_held, mix, resting, shingles

# The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou", "?": "aeiou",
}
#: Log-probabilities of the channel: a look-alike, a look-alike that is
#: dropped, another sign that is dropped, a dropped repeat.
SWAP, DROP, SKIP, REPEAT = -1.0, -1.5, -1.0, -0.7
#: Log-probability that a word of a run is none of the known ones.
UNKNOWN = -4.0
#: Character classes of the model: space, a-z, other ASCII, other letters.
SIGNS = 29
#: Beginnings of words that count as features, by length.
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 300_000

_EDGE = ".,;:!?\"'()[]{}<>%&*#|-_~`=/\\"
#: Signs at a chunk's edges that can stand for no letter.
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LOOKALIKES)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Three characters with signs between them.
_SPELLED = re.compile(r"\w[^\s\w]+\w[^\s\w]+\w|[^\W_]_[^\W_]_[^\W_]")
_REPEATED = re.compile(r"([^\W\d_])\1+")
_SUSPECT = re.compile(r"([^\W\d_])\1|[^\W\d_][^\s\w]+[^\W\d_]|[^\W\d_]_[^\W\d_]|[^\W\d_][0-9@$!|+(<€£#*?]|[0-9@$!|+(<€£#*?][^\W\d_]")


def _class_table() -> np.ndarray:
    table = np.full(256, 27, dtype=np.int32)
    table[list(b" \t\n\r\x0b\x0c")] = 0
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[0xC0:] = 28
    table[0x80:0xC0] = -1  # the rest of a character
    return table


CLASSES = _class_table()


class _Classes(dict):
    def __missing__(self, char: str) -> int:
        self[char] = out = int(CLASSES[char.encode()[0]])
        return out


_CLASS = _Classes()


def _class(char: str) -> int:
    return _CLASS[char]


def character_counts(docs: DataFrame, text: str = "text") -> list[tuple[int, int]]:
    """Trigram counts (cell, n) over the whole corpus; at most SIGNS ** 3 cells.

    Null and empty texts count as one space, repeated rows count each, an empty table gives no cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        total = np.zeros(SIGNS**3, dtype=np.int64)
        for batch in batches:
            for body in batch.column(0):
                s = CLASSES[np.frombuffer(b" " + body.as_py() + b" ", dtype=np.uint8)]
                s = s[s >= 0]
                total += np.bincount((s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], names=["cell", "n"])

    parts = docs.select(text_bytes(text).alias("body")).mapInArrow(resting(run), "cell long, n long")
    return [(r["cell"], r["n"]) for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()]


def character_model(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """log P(c | a, b), each order smoothed by the next lower one."""
    n3 = np.zeros((SIGNS,) * 3)
    for cell, n in counts:
        n3.flat[cell] = n
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SIGNS)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5))


@dataclass
class Decoder:
    """Restores obfuscated words; ``model`` as :func:`character_model` gives it.

    ``lexicon``: known words with their log-probabilities, by which runs are parted.
    """

    model: list = field(repr=False)
    lexicon: dict[str, float] = field(repr=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.lengths = sorted({len(w) for w in self.lexicon})
        self.after = [row for rows in self.model for row in rows]  # by the two classes before, as one number

    def options(self, word: str, meant: bool = False, broken: bool = False) -> list[list[tuple[str, float]]]:
        """The lattice: per character what it may stand for, with the channel's log-probability.

        ``meant``: every look-alike stands for a letter; else it may be dropped as well.
        ``broken``: a sign that may be dropped may be a word's end instead.  A space is either.
        """
        out = []
        before = ""
        for c in word:
            if c == " ":
                out.append([("", 0.0), (" ", 0.0)])
                continue
            own = [(c, 0.0)] if c.isalpha() else []
            own += [(x, SWAP) for x in LOOKALIKES.get(c, "")]
            if not c.isalpha() and not (meant and own):
                cost = DROP if own else SKIP
                own += [("", cost), (" ", cost)] if broken else [("", cost)]
            if c == before:
                own.append(("", REPEAT))
            before = c
            out.append(own)
        return out

    def restore(self, word: str, meant: bool = False, broken: bool = False) -> str:
        """The likeliest plain word, or words; ties go to the first found.

        At most SIGNS ** 2 states a character; paths are links to what lies before.
        """
        after = self.after
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for own in self.options(word, meant, broken):
            following: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, done) in best.items():
                gains, shifted = after[state], state % SIGNS * SIGNS
                for letter, cost in own:
                    if letter:
                        c = _CLASS[letter]
                        to, gain, path = shifted + c, score + cost + gains[c], (done, letter)
                    else:
                        to, gain, path = state, score + cost, done
                    known = following.get(to)
                    if known is None or gain > known[0]:
                        following[to] = (gain, path)
            best = following
        path = max(best.items(), key=lambda x: x[1][0] + after[x[0]][0])[1][1]
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))

    def parted(self, letters: str) -> list[str]:
        """The likeliest words that letters written without spaces hold, in linear time.

        A word is a known one, or any other under the character model.
        """
        model, known = self.model, self.lexicon.get
        ends: list[tuple[float, int]] = [(0.0, 0)]  # best score of words up to here, and the last one's start
        opened = (-math.inf, 0)  # an unknown word of two letters or more that goes on, and its start
        cs = [0, *map(_class, letters), 0]
        for k in range(1, len(letters) + 1):
            a, b, c = cs[k - 2] if k > 1 else 0, cs[k - 1], cs[k]
            first = ends[k - 1][0] + UNKNOWN + model[0][0][c]  # a word's first letter
            best = (first + model[0][c][0], k - 1)
            if k > 1:
                second = (ends[k - 2][0] + UNKNOWN + model[0][0][b] + model[0][b][c], k - 2)
                opened = max((opened[0] + model[a][b][c], opened[1]), second)
                best = max(best, (opened[0] + model[b][c][0], opened[1]))
            for n in self.lengths:
                if n > k:
                    break
                p = known(letters[k - n : k])
                if p is not None:
                    best = max(best, (ends[k - n][0] + p, k - n))
            ends.append(best)
        out, k = [], len(letters)
        while k:
            out.append(letters[ends[k][1] : k])
            k = ends[k][1]
        return out[::-1]

    def spelled(self, word: str, meant: bool) -> set[str]:
        """Words of what may be several, each letter apart by a sign or space: as they restore, and as known words part them."""
        found = self.restore(word, meant, broken=True).split()
        return {*found, *self.parted("".join(found))}

    def readings(self, chunk: str) -> list[str]:
        """Plain words that a chunk without spaces (lower case) may hold: its letters, and what it restores to.

        Signs at its edges may be letters or not: it is restored with them and without.
        """
        bare = chunk.strip(_EDGE)
        out = [bare] if bare.isalpha() else _LETTERS.findall(bare)
        for c in {bare, chunk.strip(_PLAIN_EDGE)}:
            once = _REPEATED.sub(r"\1", c)
            if c.isalpha():
                if once != c:  # the channel's repeats, and whatever the model thinks of double letters
                    out += [self.restore(c), once]
                continue
            apart = _SPELLED.search(c) and _LETTERS.search(c)
            if apart or _SUSPECT.search(c):
                out += {self.restore(c), self.restore(c, meant=True)}
                if once != c:
                    out += _LETTERS.findall(once) if once.isalpha() else [self.restore(once, meant=True)]
                if apart:
                    out += self.spelled(c, False) | self.spelled(c, True)
        return out

    def spaced(self, chunks: list[str]) -> list[str]:
        """Words spelled with a space after each character: runs of three or more single ones.

        A run is read as one word, and as the words that it parts into.
        """
        out, run = [], []
        for c in [*chunks, "ab"]:
            if len(c) > 1 and not (c[0].isalnum() and c[-1].isalnum()):
                c = c.strip(_EDGE) or c
            if len(c) == 1:
                run.append(c)
            elif run:
                if len(run) >= 3 and len(set(run)) > 1:
                    out += self.parted("".join(filter(str.isalpha, run)))
                    for meant in (False, True):
                        whole = self.restore("".join(run), meant)
                        out += {whole, *self.parted(whole), *self.spelled(" ".join(run), meant)}
                run = []
        return out


def features(word: str, alone: frozenset[str] = frozenset()) -> list[str]:
    """The word and its beginnings; of words in ``alone`` only the word."""
    whole = f"={word}"
    return [whole] if whole in alone else [whole, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]


class Scorer:
    """Log-odds of a text from the learned weights."""

    def __init__(self, decoder: Decoder, weights: dict[str, float], nothing: float) -> None:
        self.decoder, self.weights, self.nothing, self.cache = decoder, weights, nothing, {}
        self.whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.stems = {f[1:]: w for f, w in weights.items() if f[0] == "^"}
        self.lengths = sorted({len(x) for x in self.stems})

    def _best(self, words: Iterable[str]) -> float:
        """The largest weight among the words' :func:`features`."""
        whole, stem, best = self.whole.get, self.stems.get, -math.inf
        for w in words:
            own = whole(w)
            if own is not None and own > best:
                best = own
            for k in self.lengths:
                if len(w) <= k:
                    break
                own = stem(w[:k])
                if own is not None and own > best:
                    best = own
        return best

    def found(self, text: str) -> list[float]:
        """Weights of the distinct chunks that have any, the largest first."""
        chunks = text.lower().split()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, []
        for c in set(chunks):
            w = cache.get(c)
            if w is None:
                w = cache[c] = self._best(self.decoder.readings(c))
            if w > -math.inf:
                out.append(w)
        w = self._best(self.decoder.spaced(chunks))
        if w > -math.inf:
            out.append(w)
        return sorted(out, reverse=True)

    def score(self, text: str) -> float:
        """Between 0 and 1.  The strongest sign decides, further ones add a little."""
        found = self.found(text)
        odds = found[0] + 0.5 * sum(1 for w in found[1:] if w > 0) if found else self.nothing
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


@dataclass(frozen=True)
class Training:
    """Bounds and thresholds of the fit.

    max_toxic, max_clean: labelled rows that are read, the first by hash of their id (the
    documented bound on the classifier's sample; all else covers the whole corpus).
    A feature needs ``least`` toxic rows, ``precision`` among its rows, and a log-likelihood ratio of
    ``evidence`` beyond what the best of so many candidates has by chance (twice the logarithm of their number).  Beginnings of a word that ``frequent`` of the toxic rows
    have must show themselves in other words.
    """

    max_toxic: int = 4000
    max_clean: int = 8000
    least: int = 4
    evidence: float = 10.0
    precision: float = 0.7
    frequent: float = 0.05


def _g2(a: float, b: float, n1: float, n0: float) -> float:
    """Dunning's statistic of a in n1 against b in n0."""
    p = (a + b) / (n1 + n0)
    term = lambda k, n, q: (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)
    safe = lambda x: min(max(x, 1e-12), 1 - 1e-12)
    return 2 * (term(a, n1, safe(a / n1)) + term(b, n0, safe(b / n0)) - term(a, n1, safe(p)) - term(b, n0, safe(p)))


#: Minima of hashed three-word runs that a sampled text is known by, and how many copies share.
MINIMA, SHARED = 8, 3


def _words(texts: DataFrame, decoder: Decoder) -> DataFrame:
    """toxic, words, minima of every sampled text: the distinct words it may hold, and what near copies of it share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex()
        cache: dict[str, list[str]] = {}
        for batch in batches:
            words, minima = [], []
            for text in batch.column(1).to_pylist():
                chunks = text.lower().split()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                for c in set(chunks):
                    if c not in cache:
                        cache[c] = decoder.readings(c)
                words.append(sorted({w for c in set(chunks) for w in cache[c]} | set(decoder.spaced(chunks))))
                runs = shingles(index.hashed(text.lower().encode().split()), 3)
                minima.append([int((mix(runs + np.uint64(k)) >> np.uint64(1)).min()) for k in range(MINIMA)] if len(runs) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(minima, pa.list_(pa.int64()))], names=["toxic", "words", "minima"])

    return durable(texts.mapInArrow(run, "toxic boolean, words array<string>, minima array<long>"), "sample-words")


def _counts(words: DataFrame, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
    """Rows that have a feature, of the wanted ones or all, by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for own in batch.column(0).to_pylist():
                found = {f for w in own for f in features(w)}
                total.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

    out = words.select("words").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return {r["feature"]: r["n"] for r in out.where(F.col("n") >= least).collect()}


def _incidence(words: DataFrame, wanted: frozenset[str], alone: frozenset[str]) -> list[list[str]]:
    """The wanted features of each sampled text, near copies of a text once.

    Copies of a toxic row share all its words, which would then pass for signs; likewise the
    beginnings of a frequent sign, so that words in ``alone`` have none here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({f for w in some for f in features(w, alone)} & wanted) for some in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), batch.column(1)], names=["own", "minima"])

    out, seen = [], {}
    rows = words.select("words", "minima").mapInArrow(run, "own array<string>, minima array<long>").collect() if wanted else []
    for k, r in enumerate(sorted(rows, key=lambda r: (r["minima"], r["own"]))):
        like = Counter(seen[x] for x in enumerate(r["minima"]) if x in seen)
        if like and max(like.values()) >= SHARED:
            continue
        for x in enumerate(r["minima"]):
            seen.setdefault(x, k)
        out.append(r["own"])
    return out


def train(docs: DataFrame, labels: DataFrame, decoder: Decoder, training: Training = Training(), held_out: int = 0) -> Scorer:
    """Learn weights from labelled rows whose fold is not ``held_out``.

    ``labels`` has doc_id and toxic; rows with a null in either, or without a document, are
    passed over.  Without toxic rows there are no weights and every text scores alike.
    The sample is read from the documents once, and decoded twice: to learn its words, and
    with them.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where((fold("doc_id") != held_out) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    usable = durable(usable.join(named.select("doc_id"), "doc_id", "left_semi").distinct(), "labels")
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda toxic, most: usable.where(F.col("toxic") == F.lit(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = durable(first(True, training.max_toxic).unionByName(first(False, training.max_clean)), "label-sample")  # a bounded number of rows
    texts = durable(named.join(F.broadcast(ids), "doc_id").select("toxic", "text"), "sample-texts")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        return Scorer(decoder, {}, -0.01)

    bad = _counts(_words(texts.where("toxic"), decoder), None, training.least)
    known = sum(n for f, n in bad.items() if f[0] == "=")
    decoder = Decoder(decoder.model, {f[1:]: math.log(n / known) for f, n in bad.items() if f[0] == "=" and len(f) > 1})
    words = _words(texts, decoder)  # with the words that runs part into
    bad = _counts(words.where("toxic"), None, training.least)
    good = _counts(words.where("not toxic"), frozenset(bad), 1)
    # clean rows stand for as many as there are beside the toxic ones
    scale = (totals.get(False, 0) / max(1, n_clean)) / (totals.get(True, 1) / n_toxic)
    evidence = training.evidence + 2 * math.log(max(1, len(bad)))

    def signs(counted: dict[str, int], n: int) -> dict[str, float]:
        out = {}
        for f, a in counted.items():
            b = good.get(f, 0)
            share = (a + 0.5) / (a + b * scale + 1)
            if a >= training.least and share >= training.precision and _g2(a, b, n, max(1, n_clean)) >= evidence:
                out[f] = math.log(share / (1 - share))
        return out

    likely = frozenset(signs(bad, n_toxic))
    alone = frozenset(f for f in likely if f[0] == "=" and bad[f] >= training.frequent * n_toxic)
    held = _incidence(words.where("toxic"), likely, alone)
    weights = signs(Counter(f for own in held for f in own), max(1, len(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [not any(f in weights for w in own for f in features(w)) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(none, pa.bool_())], names=["toxic", "none"])

    without = words.select("toxic", "words").mapInArrow(run, "toxic boolean, none boolean").where("none")
    missed = {r["toxic"]: r["n"] for r in without.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = math.log((missed.get(True, 0) + 0.5) / (missed.get(False, 0) * scale + 0.5))
    return Scorer(decoder, weights, min(-0.01, nothing))


def score_toxicity(docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """score (0 to 1) and predicted of every row, beside the columns in ``keep``.

    Texts are read whole.  Null, empty and blank texts score as texts without any sign.
    Rows are independent: repeated rows and null ids need no care.  No shuffle.
    """
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("body"))
    names = [*own.columns[:-1], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            scores = [scorer.score(x.as_py()) for x in batch.column(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=names)

    kept = "".join(f"k{i} {own.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    out = own.mapInArrow(resting(run), f"{kept}score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Scorer:
    """Character model of all documents, then weights from the labelled ones.

    Null and empty texts, null and repeated ids, rows without a label and empty tables are
    treated as :func:`character_counts` and :func:`train` say.
    """
    return train(docs, labels, Decoder(character_model(character_counts(docs)).tolist()), training)
