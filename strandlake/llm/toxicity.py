"""Toxicity scores of deobfuscated text: a noisy channel, then a linear model.

Words may be disguised by look-alike signs, repeated letters, marks between letters or
spacing.  A disguised word is a lattice of readings; Viterbi decoding finds the likeliest
under a character trigram model, readings that are known words coming first.  Words
that hold letters only, none three times running and none twice unless the word is
known, have a single reading and aren't decoded.  A run of spaced letters is read as one
word and as the likeliest row of words, known ones of any length standing anywhere in it;
both take time in proportion to its length.  The score comes from a logistic regression on restored words and their
beginnings, each counted once a document.

The character model, the known words and the regression are fitted on every labelled
document, whole.  Words, their trigrams and the documents of each feature are counted in
tasks and summed by Spark; a document is decoded once, and its restored words are kept for
the counts and for the regression, which Spark's own fits.  Near copies (the same three
lowest hashes of five words) of one label count once.  A known word stands twice and at
least once in KNOWN_WORDS words, so that no more than so many are known.

Defined results: null and empty texts get the score of a text without any signal.  A
document labelled several times is toxic if any label is.  Without labels of both kinds
every score is 0.  Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import cut, remainder
from strandlake.llm.words import mix64, slices, split_words, window_hashes, window_starts

#: A known word stands at least once in so many words of the labelled documents.
KNOWN_WORDS = 1_000_000
MIN_DOCS = 3
MIN_Z = 3.5
#: Documents that a word needs to be an example by itself.
ALONE_DOCS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Bits that mark features of toxic documents by hash.
MARKS = 1 << 24
#: What the square of a weight costs in the regression.
RIDGE = 1e-6
#: Words a worker remembers, and the letters of the longest one of them.
CACHE_WORDS = 400_000
CACHE_LETTERS = 64

# Signs read as letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "%": "x",
}
SEPARATORS = set(".-_*~'`,/\\^=#&:;")
_EDGE = ".,;:?!\"'()[]{}<>«»“”‘’`~^-_*/\\…"
_QUOTES = ".,;:?\"'[]}«»“”‘’…"
_DOUBLE = re.compile(r"([^\W\d_])\1")
_TRIPLE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ \t]+\S){2,}(?=\s|$)")
#: The last two signs of any spaced run: found in a fifth of the time, and in few texts.
_SPACED_END = re.compile(r"[ \t]\S[ \t]+\S(?!\S)")
#: Letters that a known word needs to be told within a spaced run; what each of its letters is worth there, less a price
#: for the word (so one long word is worth more than its parts), and the price to begin anew after letters that are no word.
LEAST_WORD, WORD_LETTER, WORD_PRICE, BREAK = 3, 3.0, 6.0, 2.0

#: Costs of a look-alike, a dropped separator, a dropped look-alike, a shortened long run, a shortened
#: pair; what a letter and a known word are worth, so that readings don't win by leaving letters out.
_COST_LIKE, _COST_DROP, _COST_LOSE, _COST_RUN, _COST_PAIR, LETTER, KNOWN_WORD = 1.0, 0.5, 6.0, 0.5, 4.0, 2.5, 6.0


def _known(words: dict[str, int], total: int) -> set[str]:
    return {w for w, n in words.items() if n >= 2 and n * KNOWN_WORDS >= total}


def _grams(words: dict[str, int]) -> Counter:
    """Weights of the trigrams of distinct words with these counts, whole numbers so that sums don't depend on an order."""
    out: Counter = Counter()
    for w, n in words.items():
        weight = round((1 + math.log(n)) * (1 << 20))
        marked = f"^^{w}$"
        for i in range(2, len(marked)):
            out[marked[i - 2 : i + 1]] += weight
    return out


class CharModel:
    """Interpolated character trigrams; words are weighted by the logarithm of their count."""

    def __init__(self, words: dict[str, int]):
        self._fill(_known(words, sum(words.values())), _grams(words))

    @classmethod
    def summed(cls, known: Iterable[str], grams: dict[str, int]) -> CharModel:
        """From known words and the weights of trigrams (``_grams``), summed over all words."""
        made = cls.__new__(cls)
        made._fill(set(known), grams)
        return made

    def _fill(self, known: set[str], grams: dict[str, int]):
        self.known = known
        tri: dict[str, dict[str, int]] = defaultdict(dict)
        one: Counter = Counter()
        for gram in sorted(grams):
            tri[gram[:2]][gram[2]] = grams[gram]
            one[gram[2]] += grams[gram]
        total = sum(one.values()) or 1
        self.base = {c: n / total for c, n in one.items()}
        self.tri = {h: (sum(c.values()), c) for h, c in tri.items()}
        self._open()

    def _open(self):
        #: What the known words begin with, so that a reading that begins like none is known by its last two letters alone.
        self.begins = {w[:i] for w in self.known for i in range(len(w) + 1)}
        self._logs: dict[str, float] = {}

    def __getstate__(self):
        return self.known, self.base, self.tri

    def __setstate__(self, state):
        self.known, self.base, self.tri = state
        self._open()

    def log(self, history: str, c: str) -> float:
        found = self._logs.get(history + c)
        if found is None:
            if len(self._logs) > CACHE_WORDS:
                self._logs.clear()
            low = 0.2 * self.base.get(c, 1e-6) + 1e-7
            seen = self.tri.get(history)
            found = self._logs[history + c] = math.log(low + (0.8 * seen[1].get(c, 0.0) / seen[0] if seen else 0.0))
        return found


_SINGLE: dict[str, list[tuple[str, int, float]]] = {}


def _readings(c: str) -> list[tuple[str, int, float]]:
    """What one sign that isn't repeated may stand for: text, length, cost."""
    found = _SINGLE.get(c)
    if found is None:
        if c.isalpha():
            found = [(c, 1, 0.0)]
        else:
            found = [(x, 1, _COST_LIKE) for x in LOOKALIKES.get(c, "")] + [("", 1, _COST_DROP if c in SEPARATORS else _COST_LOSE)]
        if len(_SINGLE) < 10_000:
            _SINGLE[c] = found
    return found


def lattice(token: str) -> Iterator[tuple[str | None, list[tuple[str, int, float]]]]:
    """For each place of a lower-case token its readings: text, how many places it takes, cost; with a name for readings that recur.

    A long run is shortened where it begins: to drop some of its signs first costs more.
    """
    run = begin = 0
    for i, c in enumerate(token):
        while run < len(token) and (run <= i or token[run] == c):
            run += 1
        if i and token[i - 1] != c:
            begin = i
        many = run - i
        if many == 1:
            yield c, _readings(c)
            continue
        letters = [x for x in _readings(c) if x[0]]
        lost = [x for x in _readings(c) if not x[0]]
        if many == 2:
            yield c + c, letters + [(x, 2, cost + _COST_PAIR) for x, _, cost in letters] + lost
        elif i > begin:
            yield None, []
        else:  # of three and more in a row, one or two are left
            short = [(x * n, many, cost + _COST_RUN) for n in (1, 2) for x, _, cost in letters]
            yield None, short + [("", many - 2, (many - 2) * cost) for _, _, cost in lost]


def _moves(state: tuple, choices: list[tuple[str, int, float]], model: CharModel) -> list[tuple[int, float, tuple, str]]:
    """Where readings lead from a state: places taken, value, next state, text."""
    begin, last = state
    out = []
    for emit, length, cost in choices:
        value, now = -cost, last
        for c in emit:
            value += LETTER + model.log(now, c)
            now = now[1] + c
        grown = begin + emit if begin is not None else None
        out.append((length, value, (grown if grown in model.begins else None, now), emit))
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token, known words preferred: Viterbi.

    Two readings go on alike if they end in the same two letters and neither begins a
    known word; one that does is a state of its own.  So a place has as many states as
    the known words and pairs of letters allow, however long the token is.
    """
    moves: dict[tuple, list] = {}
    parent, letters = array("q"), array("i")  # of each reading of a place: the one it goes on from, and the number of the text it adds
    texts: dict[str, int] = {}
    # a state: the reading where it begins a known word, else None; its last two letters
    waiting: dict[int, dict[tuple, tuple[float, int, str]]] = {0: {("", "^^"): (0.0, -1, "")}}
    for i, (name, choices) in enumerate(lattice(token)):
        for state, (score, step, text) in waiting.pop(i, {}).items():
            parent.append(step)
            letters.append(texts.setdefault(text, len(texts)))
            step = len(parent) - 1
            found = moves.get((name, state)) if name else None
            if found is None:
                found = _moves(state, choices, model)
                if name:
                    moves[name, state] = found
            for length, gain, after, emit in found:
                value = score + gain
                states = waiting.get(i + length)
                if states is None:
                    states = waiting[i + length] = {}
                held = states.get(after)
                if held is None or value > held[0]:
                    states[after] = (value, step, emit)
    best, at, text = -math.inf, -1, ""
    for (begin, last), (score, step, emit) in waiting.get(len(token), {}).items():
        value = score + model.log(last, "$") + (KNOWN_WORD if begin in model.known else 0.0)
        if value > best:
            best, at, text = value, step, emit
    names, out = list(texts), [text]
    while at >= 0:
        out.append(names[letters[at]])
        at = parent[at]
    return "".join(reversed(out))


def _one_pair(word: str, at: int, model: CharModel) -> str:
    """As ``decode``, for letters of which only those at ``at`` and after it are equal neighbours: the better of two readings."""
    short = word[:at] + word[at + 1 :]
    score, last, values = 0.0, "^^", []
    for c in word[:at]:
        score += LETTER + model.log(last, c)
        last = last[1] + c
    for rest, cost in ((word[at:], 0.0), (short[at:], _COST_PAIR)):
        value, now = score, last
        for i, c in enumerate(rest):
            value += (LETTER + model.log(now, c)) if i else (LETTER + model.log(now, c) - cost)
            now = now[1] + c
        values.append(value + model.log(now, "$") + (KNOWN_WORD if word[:at] + rest in model.known else 0.0))
    return word if values[0] >= values[1] else short


def _decoded(core: str, model: CharModel) -> str:
    """``decode``, by two readings where there are no more."""
    if core.isalpha():
        pairs = [i for i, (a, b) in enumerate(zip(core, core[1:])) if a == b]
        if len(pairs) == 1:
            return _one_pair(core, pairs[0], model)
    return decode(core, model)


def _without_tail(core: str, least: int) -> str:
    """Without a run of ``least`` or more of one sign at the end."""
    if core and not (core[-1].isalnum() or core[-1] == "_"):
        short = core.rstrip(core[-1])
        if len(core) - len(short) >= least:
            return short
    return core


def plain(token: str) -> str | None:
    """The one reading of a word of letters, or None for a disguised word."""
    core = token.lower().strip(_EDGE)
    if core.isalpha() and not _TRIPLE.search(core):
        return core
    core = _without_tail(core, 2)
    if core.isalpha() and not _TRIPLE.search(core):
        return core
    return None if any(c.isalpha() or c in LOOKALIKES for c in token.lower()) else ""


def disguised(word: str | None, model: CharModel) -> bool:
    """Whether what ``plain`` gave is to be decoded: it has no one reading, or a doubled letter and isn't known."""
    return word is None or (word not in model.known and bool(_DOUBLE.search(word)))


def disguise(token: str) -> str:
    """The part of a token that is decoded."""
    return _without_tail(token.lower().strip(_QUOTES).rstrip("!"), 3)


def restore(token: str, model: CharModel) -> str:
    word = plain(token)
    return _decoded(disguise(token), model) if disguised(word, model) else word


def segments(run: str, model: CharModel) -> list[str]:
    """The likeliest words of a run of signs without blanks: Viterbi as in ``decode``, with an arc from each place's best state to a new word."""
    fresh = ("", "^^")
    moves: dict[tuple, list] = {}
    ends: dict[tuple, float] = {}
    parent, letters = array("q"), array("i")
    texts: dict[str, int] = {"": 0, " ": 1}
    waiting: dict[int, dict[tuple, tuple[float, int, str]]] = {0: {fresh: (0.0, -1, "")}}
    for i, (name, choices) in enumerate(chain(lattice(run), [(None, [])])):
        states = waiting.pop(i, {})
        best, least = -math.inf, None
        steps = []
        for state, (score, step, text) in states.items():
            parent.append(step)
            letters.append(texts.setdefault(text, len(texts)))
            steps.append((state, score, len(parent) - 1))
            end = ends.get(state)
            if end is None:
                end = ends[state] = _ended(state, model) if state != fresh else -math.inf
            if score + end > best:
                best, least = score + end, len(parent) - 1
        if i == len(run):
            break
        if least is not None and best > states.get(fresh, (-math.inf,))[0]:
            parent.append(least)
            letters.append(1)
            steps = [x for x in steps if x[0] != fresh] + [(fresh, best, len(parent) - 1)]
        for state, score, step in steps:
            found = moves.get((name, state)) if name else None
            if found is None:
                found = _moves(state, choices, model)
                if name:
                    moves[name, state] = found
            for length, gain, after, emit in found:
                value = score + gain
                row = waiting.get(i + length)
                if row is None:
                    row = waiting[i + length] = {}
                held = row.get(after)
                if held is None or value > held[0]:
                    row[after] = (value, step, emit)
    names, out, at = list(texts), [], -1 if least is None else least
    while at >= 0:
        out.append(names[letters[at]])
        at = parent[at]
    return "".join(reversed(out)).split()


def _ended(state: tuple, model: CharModel) -> float:
    """What it is worth to end a word of a spaced run in a state."""
    begin, last = state
    if begin in model.known and len(begin) >= LEAST_WORD:
        return model.log(last, "$") + WORD_LETTER * len(begin) - WORD_PRICE
    return -BREAK


def spaced(text: str, model: CharModel) -> list[str]:
    """Words spelt out with blanks between their letters: the run as one word, and the words in it."""
    out: list[str] = []
    if not _SPACED_END.search(text):
        return out
    for m in _SPACED.finditer(text):
        run = "".join(m.group().split()).lower()
        out.append(decode(run, model))
        out += segments(run, model)
    return out


def features(word: str) -> list[str]:
    return [f"{word}$"] + [word[:n] for n in PREFIXES if len(word) > n] if word else []


class Model:
    def __init__(self, chars: CharModel | None, weights: dict[str, float], bias: float):
        self.chars, self.weights, self.bias = chars, weights, bias
        #: Tokens with signals, and tokens and beginnings of tokens without any.
        self.cache: dict[str, tuple[str, ...]] = {}
        self.quiet: set[str] = set()
        self.calm: dict[str, bool] = {}
        #: What a word with a weight begins with, its end included, and what leads there.
        self.heads = {f[: PREFIXES[0]] for f in weights}
        self.starts = {h[:i] for h in self.heads for i in range(len(h))}
        self.pairs = {h[:2] for h in self.heads}

    def __getstate__(self):
        return self.chars, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _begins(self, core: str) -> bool:
        """Whether any reading of a token begins like a word with a weight; one that doesn't has no signal, whichever reading wins."""
        waiting: dict[int, set[str]] = {0: {""}}
        for i, (_, choices) in enumerate(lattice(core)):
            for own in waiting.pop(i, ()):
                for emit, length, _ in choices:
                    grown = own + emit
                    if grown[: PREFIXES[0]] in self.heads:
                        return True
                    if grown in self.starts:
                        waiting.setdefault(i + length, set()).add(grown)
            if not waiting:
                return False
        return any(f"{own}$" in self.heads for own in waiting.get(len(core), ()))

    def _calm(self, begin: str) -> bool:
        """Whether no token that begins so has a signal: no reading changes the unlike letters it begins with."""
        low = begin.lower()
        if begin != low and not begin.isascii():
            return False
        for n, held in ((2, self.pairs), (PREFIXES[0], self.heads)):
            own = low[:n]
            if len(own) == n and own.isalpha() and own not in held and all(a != b for a, b in zip(own, own[1:])):
                return True
        return False

    def _signals(self, token: str) -> tuple[str, ...]:
        begin = token[: PREFIXES[0]]
        calm = self.calm.get(begin)
        if calm is None:
            if len(self.calm) > CACHE_WORDS:
                self.calm.clear()
            calm = self.calm[begin] = self._calm(begin)
        if calm:
            return ()
        word = plain(token)
        if disguised(word, self.chars):
            core = disguise(token)
            word = _decoded(core, self.chars) if self._begins(core) else ""
        elif f"{word}$"[: PREFIXES[0]] not in self.heads:
            return ()
        return tuple(f for f in features(word) if f in self.weights)

    def score(self, text: str | None) -> float:
        if self.chars is None:
            return 0.0
        active: set[str] = set()
        if text:
            if len(self.cache) + len(self.quiet) > CACHE_WORDS:
                self.cache.clear()
                self.quiet.clear()
            cache, quiet = self.cache, self.quiet
            for token in set(text.split()) - quiet:
                found = cache.get(token)
                if found is None:
                    found = self._signals(token)
                    if len(token) <= CACHE_LETTERS:
                        if found:
                            cache[token] = found
                        else:
                            quiet.add(token)
                active.update(found)
            for word in spaced(text, self.chars):
                active.update(f for f in features(word) if f in self.weights)
        z = self.bias + sum(self.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def restored(text: str, chars: CharModel, cache: dict[str, str]) -> set[str]:
    """The distinct restored words of a text."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    tokens = set(text.split())
    for token in tokens.difference(cache):
        cache[token] = restore(token, chars)
    out = set(map(cache.__getitem__, tokens))
    out.update(spaced(text, chars))
    out.discard("")
    return out


def _features_of(words: Iterable[str]) -> set[str]:
    return {f for word in words for f in features(word)}


def sketches(texts: pa.Array) -> np.ndarray:
    """A hash of each text's three lowest hashes of five words (of all its words, if fewer): near copies mostly share it."""
    w = split_words(texts)
    h, count = w.hashes(lower=True), w.counts()
    out = np.zeros(len(count), np.uint64)
    for i in range(4):
        some = np.flatnonzero((count > i) & (count < 5))
        out[some] = mix64(out[some] + h[w.first[some] + i])
    most = np.uint64(2**64 - 1)
    at = window_starts(w.first, 5)
    if len(at):
        found, rows = window_hashes(h, 5)[at], np.flatnonzero(count >= 5)
        each = count[rows] - 4
        begin = np.cumsum(each) - each
        for _ in range(3):
            low = np.minimum.reduceat(found, begin)
            out[rows] = mix64(out[rows] + low)
            found[found == np.repeat(low, each)] = most
    return out


def _odds(a, b, pos: int, neg: int):
    """How many standard errors a feature's log odds ratio is above 0, for Spark columns or numbers."""
    log, root = (F.log, F.sqrt) if hasattr(a, "cast") else (math.log, math.sqrt)
    return (log((a + 0.5) / (pos - a + 0.5)) - log((b + 0.5) / (neg - b + 0.5))) / root(1 / (a + 0.5) + 1 / (b + 0.5))


def _alone(chosen: dict[str, tuple[int, int]], pos: int, neg: int, totals: tuple[int, int]) -> list[tuple[list[str], float]]:
    """A chosen word by itself is an example too, as toxic as the documents that hold it: its features, and how toxic."""
    out = []
    for f, (a, b) in sorted(chosen.items()):
        if f.endswith("$") and a >= ALONE_DOCS:
            own = a * totals[1] / pos
            out.append(([x for x in features(f[:-1]) if x in chosen], (own + 0.1) / (own + b * totals[0] / neg + 1)))
    return out


def fit(rows: Iterable[tuple[str, int]], totals: tuple[int, int]) -> Model:
    """A model from a few (text, toxic) rows in memory, as ``train`` fits it on tables; totals: how many documents of label 0 and 1 they stand for."""
    rows = [(t or "", int(y)) for t, y in rows]
    copies = zip(sketches(pa.array([t for t, _ in rows], pa.string())).tolist(), rows, strict=True)
    rows = list({(h, y): (t, y) for h, (t, y) in copies}.values())
    pos = sum(y for _, y in rows)
    neg = len(rows) - pos
    if not pos or not neg:
        return Model(None, {}, 0.0)
    words: Counter = Counter()
    for text, _ in rows:
        words.update(w for t in text.split() if (w := plain(t)))
    chars, cache = CharModel(words), {}
    docs = [(_features_of(restored(t, chars, cache)), y) for t, y in rows]
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for found, y in docs:
        counts[y].update(found)
    chosen = {f: (a, counts[0][f]) for f, a in counts[1].items() if a >= MIN_DOCS and _odds(a, counts[0][f], pos, neg) > MIN_Z}
    examples = [(sorted(found & chosen.keys()), float(y), totals[y] / (pos if y else neg) * (pos + neg) / max(1, sum(totals))) for found, y in docs]
    examples += [(found, y, 3.0) for found, y in _alone(chosen, pos, neg, totals)]
    place = {f: i for i, f in enumerate(sorted(chosen))}
    y, weight = (np.array([x[i] for x in examples]) for i in (1, 2))
    r = np.repeat(np.arange(len(examples)), [len(x[0]) for x in examples])
    c = np.array([place[f] for x in examples for f in x[0]], int)
    w, bias = np.zeros(len(place)), float(np.log(max(totals[1], 1) / max(totals[0], 1)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 801):  # Adam on the weighted log loss
        z = bias + np.bincount(r, weights=w[c], minlength=len(y)) if len(c) else np.full(len(y), bias)
        d = weight * (1 / (1 + np.exp(-z)) - y) / len(y)
        grad = np.append(np.bincount(c, weights=d[r], minlength=len(w)) + RIDGE * w, d.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(chars, {f: float(w[i]) for f, i in place.items()}, bias)


def _sketched(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found = pa.array(sketches(part.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), found], names=["doc_id", "key", "sketch"])


def _counted(counts: dict, names: tuple[str, ...]) -> pa.RecordBatch:
    """Counts, or tuples of them, by their key; the keys are dropped from ``counts``."""
    values = [x if isinstance(x, (list, tuple)) else (x,) for x in counts.values()]
    columns = [pa.array(list(counts), pa.string()), *[pa.array([x[i] for x in values], pa.int64()) for i in range(len(names) - 1)]]
    counts.clear()
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _plain_words(batches):
    """Words with a single reading of (text), with counts."""

    def summed(tokens: Counter) -> pa.RecordBatch:
        words: dict[str, int] = {}
        for token, n in tokens.items():
            if word := plain(token):
                words[word] = words.get(word, 0) + n
        tokens.clear()
        return _counted(words, ("word", "n"))

    tokens: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            tokens.update(text.split())
            if len(tokens) > CACHE_WORDS:
                yield summed(tokens)
    yield summed(tokens)


def _gram_sums(batches):
    for batch in batches:
        yield _counted(_grams(dict(zip(*(batch.column(c).to_pylist() for c in ("word", "n")), strict=True))), ("gram", "weight"))


def _reading(shared):
    """The restored words of (toxic, text), a line each."""

    def run(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = ["\n".join(sorted(restored(t, shared.value, cache))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(words, pa.string())], names=["toxic", "words"])

    return run


def _documents_with(shared=None):
    """How many documents hold each feature; with a bitmap of hashes, only of features that it marks."""

    def picked(word: str) -> tuple[str, ...]:
        if shared is None:
            return tuple(features(word))
        marks, least = shared.value, PREFIXES[0]
        # documents of any feature of a longer word hold its shortest beginning too
        if len(word) > least and not marks[zlib.crc32(word[:least].encode()) % MARKS]:
            return ()
        return tuple(f for f in features(word) if marks[zlib.crc32(f.encode()) % MARKS])

    def run(batches):
        counts: Counter = Counter()
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for line in batch.column("words").to_pylist():
                words = line.split("\n")
                own: set[str] = set()
                for word, found in zip(words, map(cache.get, words)):
                    if found is None:
                        found = cache[word] = picked(word)
                    if found:
                        own.update(found)
                counts.update(own)
                if len(cache) > CACHE_WORDS // 2:
                    cache.clear()
            if len(counts) > CACHE_WORDS:
                yield _counted(counts, ("feature", "n"))
        yield _counted(counts, ("feature", "n"))

    return run


def _active(shared):
    """The chosen features of each document."""

    def run(batches):
        chosen = shared.value
        heads = {f[: PREFIXES[0]] for f in chosen}
        for batch in batches:
            texts = [x.split("\n") for x in batch.column("words").to_pylist()]
            found = [sorted(_features_of(w for w in words if f"{w}$"[: PREFIXES[0]] in heads) & chosen.keys()) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["toxic", "active"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on all labelled documents (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    counted = dict(marks.groupBy("toxic").count().collect())
    totals = (counted.get(0, 0), counted.get(1, 0))
    texts = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    form = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, key long, sketch long"
    one = texts.mapInArrow(_sketched, form).join(marks, "doc_id").groupBy("toxic", "sketch").agg(F.min(F.struct("doc_id", "key")).alias("at")).select("toxic", "at.*")
    rows = cut(texts.join(one.hint("shuffle_hash"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("toxic", "text"))
    known = dict(rows.groupBy("toxic").count().collect())
    neg, pos = known.get(0, 0), known.get(1, 0)
    if not pos or not neg:
        return Model(None, {}, 0.0)
    words = cut(rows.select("text").mapInArrow(_plain_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # no more words than KNOWN_WORDS, no more trigrams than letters allow
    names = words.filter((F.col("n") >= 2) & (F.col("n") * KNOWN_WORDS >= total)).select("word").toArrow().column(0).to_pylist()
    grams = words.mapInArrow(_gram_sums, "gram string, weight long").groupBy("gram").agg(F.sum("weight")).toArrow()
    chars = CharModel.summed(names, dict(zip(*(c.to_pylist() for c in grams.columns), strict=True)))
    read = cut(rows.mapInArrow(_reading(spark.sparkContext.broadcast(chars)), "toxic int, words string"))
    form = "feature string, n long"
    toxic = read.filter("toxic = 1").select("words").mapInArrow(_documents_with(), form).groupBy("feature").agg(F.sum("n").alias("a"))
    toxic = cut(toxic.filter(F.col("a") >= MIN_DOCS))
    # other documents count these features; a false mark is dropped by the join
    bits = np.zeros(MARKS, bool)
    bits[toxic.select((F.crc32(F.col("feature").cast("binary")) % MARKS).cast("int").alias("bit")).distinct().toArrow().column(0).to_numpy()] = True
    marked = spark.sparkContext.broadcast(bits)
    other = read.filter("toxic = 0").select("words").mapInArrow(_documents_with(marked), form).groupBy("feature").agg(F.sum("n").alias("b"))
    held = toxic.join(other, "feature", "left").select("feature", "a", F.coalesce("b", F.lit(0)).alias("b"))
    odds = _odds(F.col("a").cast("double"), F.col("b").cast("double"), pos, neg)
    chosen = {r.feature: (r.a, r.b) for r in held.filter(odds > MIN_Z).collect()}
    if not chosen:
        return Model(chars, {}, math.log(totals[1] / totals[0]))
    share = [totals[y] / n * (pos + neg) / sum(totals) for y, n in ((0, neg), (1, pos))]
    sets = cut(read.mapInArrow(_active(spark.sparkContext.broadcast(chosen)), "toxic int, active array<string>").groupBy("toxic", "active").count())
    examples = sets.select("active", F.col("toxic").cast("double").alias("label"), (F.col("count") * F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).alias("weight"))
    alone = [(found, label, 3.0 * part) for found, y in _alone(chosen, pos, neg, totals) for label, part in ((1.0, y), (0.0, 1 - y))]
    if alone:
        examples = examples.unionAll(spark.createDataFrame(alone, "active array<string>, label double, weight double"))
    vocabulary = sorted(chosen)
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="active", outputCol="features", minTF=1.0).transform(examples)
    found = LogisticRegression(weightCol="weight", regParam=RIDGE, standardization=False, maxIter=200, tol=1e-8).fit(vectors)
    return Model(chars, dict(zip(vocabulary, found.coefficients.toArray().tolist(), strict=True)), float(found.intercept))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """score and predicted beside the kept columns."""
    picked = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # known words, trigrams and chosen features

    def run(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=[*keep, "score", "predicted"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in keep)
    return picked.mapInArrow(run, f"{kept}, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))  # a row without an id teaches nothing
    model = train(docs.filter(~held), labels.filter(~held))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), model, ("doc_id", "held_out"))
