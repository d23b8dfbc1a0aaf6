"""Toxicity by a misspelling-tolerant lexicon and its context (operator 9).

1. A lexicon is learned from a bounded sample of labelled rows: words and word beginnings that
   are more frequent in toxic documents than chance allows. With V terms tried, a term has to
   reach log likelihood ``log(V) - SLACK``, so only a handful is there by luck, at any size of the sample.
2. The lexicon is a trie; whole terms accept one edit (none if they are short), beginnings accept
   any ending. The Levenshtein automata of all terms are intersected with the trie and made
   deterministic as words need it; each state is a set of (trie node, edits spent). All words of a
   batch run through that table at once, as NumPy lanes. A word that other documents of the sample
   use is no misspelling, however near it is to a term.
3. Each hit is weighed in its window of ``WINDOW`` words: quotation marks around it, words of
   saying before it and hits near it. A logistic regression over sums of these window scores,
   trained on the same sample, gives the score; so a quoted insult weighs other than abuse.

The sample has ``SAMPLE_ROWS`` labelled rows at most (those with the least hashes of doc_id) and
is the model's size; every row's whole text is scored, and terms, their letters and the words
they meet may have any number and length.

Edge cases: null and empty texts have no hit and get the score of the bias. Without labelled
rows of both kinds the score is the toxic share of the sample (0.5 without any). Rows are judged
alone, so repeated rows get equal scores; of several labels of a doc_id the toxic one counts. An
empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import discard, keep, slices, small, table, utf8

SAMPLE_ROWS = 20_000
LEAST_ROWS = 3
LEAST_ODDS = 1.5
#: A term's log likelihood may lie so much below the log of the number of terms tried.
SLACK = 1.5
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 13)
#: Terms shorter than this accept no edit.
FUZZY_LENGTH = 5
#: Other documents of the sample that have to use a word before it counts as a word of its own.
LEAST_OTHERS = 2
WINDOW = 6
THRESHOLD = 0.7

# Words that announce quoted speech, in four languages.
SAYING = ("said", "says", "quote", "quoted", "called", "wrote", "word", "term", "dit", "disait", "mot", "citation", "sagte", "sagt", "wort", "zitat", "dijo", "dice", "palabra", "cita")
QUOTES = "\"'`“”‘’«»„‹›"
TOKEN = re.compile(r"[^\W_]+", re.U)
FEATURES = ("any", "hits", "exact", "fuzzy", "quoted", "said", "near", "density")


def held_out() -> Column:
    return F.expr("crc32(cast(doc_id as string)) % 3 = 1")


class Automaton:
    """Levenshtein automata of terms, intersected with their trie, as one transition table.

    terms: (text, is a beginning, weight). ``table[state, letter]`` is the next state, 0 none, -1
    not made yet; states are made when a word first gets there. ``known``: words that are no
    misspelling of a term.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], known: frozenset[str] = frozenset()):
        self.terms, self.known = terms, known
        letters = sorted({c for t, _, _ in terms for c in t})
        self.code = np.zeros(0x110000, np.int32)  # 0: a letter of no term
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        self.n = len(letters) + 1
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.edits = [0]  # most edits that a term below the node accepts
        for number, (t, beginning, _) in enumerate(terms):
            node, allowed = 0, self.allowed(number)
            self.edits[0] = max(self.edits[0], allowed)
            for c in t:
                k = int(self.code[ord(c)])
                if k not in self.children[node]:
                    self.children[node][k] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.edits.append(0)
                node = self.children[node][k]
                self.edits[node] = max(self.edits[node], allowed)
            self.ends[node].append(number)
        self.weights = np.array([w for _, _, w in terms] or [0.0])
        self.number: dict[frozenset, int] = {}
        self.order: list[frozenset] = []
        self.table = np.zeros((16, self.n), np.int32)
        self.whole = np.full((16, 2), -1)  # (term, edits) at the end of a word, the fewest edits first
        self.begun = np.full(16, -1)  # a beginning that is complete here
        self._state(frozenset())
        self.table[0] = 0
        self._state(self._close({0: 0}))

    def allowed(self, number: int) -> int:
        text, beginning, _ = self.terms[number]
        return 1 if not beginning and len(text) >= FUZZY_LENGTH else 0

    def _close(self, active: dict[int, int]) -> frozenset:
        """(node, edits spent) with skipped letters of terms; the least edits of each node."""
        todo = list(active.items())
        while todo:
            node, spent = todo.pop()
            if spent < self.edits[node]:
                for child in self.children[node].values():
                    if spent + 1 <= self.edits[child] and active.get(child, 9) > spent + 1:
                        active[child] = spent + 1
                        todo.append((child, spent + 1))
        return frozenset(active.items())

    def _state(self, state: frozenset) -> int:
        """The number of a state, made if it is new."""
        k = self.number.get(state)
        if k is not None:
            return k
        k = self.number[state] = len(self.order)
        self.order.append(state)
        if k == len(self.begun):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.whole = np.concatenate([self.whole, np.full_like(self.whole, -1)])
            self.begun = np.concatenate([self.begun, np.full_like(self.begun, -1)])
        self.table[k] = -1
        best = lambda x: (x[1], -self.terms[x[0]][2], x[0])
        here = [(t, spent) for node, spent in state for t in self.ends[node] if spent <= self.allowed(t)]
        whole = min((x for x in here if not self.terms[x[0]][1]), key=best, default=(-1, 0))
        self.whole[k] = whole
        self.begun[k] = min((x for x in here if self.terms[x[0]][1]), key=best, default=(-1, 0))[0]
        return k

    def _step(self, k: int, c: int) -> int:
        """The state after state k and letter c."""
        active: dict[int, int] = {}
        for node, spent in self.order[k]:
            to = self.children[node].get(c) if c else None
            if to is not None and spent <= self.edits[to] and active.get(to, 9) > spent:
                active[to] = spent
            if spent < self.edits[node]:
                if active.get(node, 9) > spent + 1:
                    active[node] = spent + 1  # a letter too many
                for child in self.children[node].values():  # a wrong letter
                    if spent + 1 <= self.edits[child] and active.get(child, 9) > spent + 1:
                        active[child] = spent + 1
        return self._state(self._close(active))

    def match(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words codes[start:stop] that match a term: the best term of each."""
        lane = np.arange(len(start))
        state = np.ones(len(start), np.int64)
        best, edits = np.full(len(start), -1), np.zeros(len(start), int)
        t = 0
        while len(lane):
            begun = self.begun[state]
            better = (begun >= 0) & ((best[lane] < 0) | (self.weights[begun] > self.weights[best[lane]]))
            best[lane[better]] = begun[better]
            on = stop[lane] - start[lane] > t
            term, spent = self.whole[state[~on]].T
            ended, old = lane[~on], best[lane[~on]]
            better = (term >= 0) & ((old < 0) | (spent == 0) & (self.weights[term] > self.weights[old]))
            best[ended[better]], edits[ended[better]] = term[better], spent[better]
            lane, state = lane[on], state[on]
            letter = codes[start[lane] + t]
            after = self.table[state, letter]
            if (after < 0).any():
                for k, c in np.unique(np.stack([state[after < 0], letter[after < 0]]), axis=1).T.tolist():
                    to = self._step(k, c)
                    self.table[k, c] = to
                after = self.table[state, letter]
            alive = after > 0
            lane, state = lane[alive], after[alive].astype(np.int64)
            t += 1
        word = np.flatnonzero(best >= 0)
        return word, best[word], edits[word]


_SPACE, _LETTER, _QUOTE = 0, 1, 2


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = _LETTER
    out[[ord(c) for c in QUOTES]] = _QUOTE
    return out


_kind: list[np.ndarray] = []


def features(texts: list[str], automaton: Automaton) -> np.ndarray:
    """FEATURES of each text; window scores are sums over its hits."""
    if not _kind:
        _kind.append(_classes())
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower))
    kind = _kind[0][points]
    letter = kind == _LETTER
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum(size) - size
    text_of = np.searchsorted(first, start, "right") - 1
    n_words = np.bincount(text_of, minlength=len(texts))
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(start):
        return out
    word, term, spent = automaton.match(automaton.code[points], start, stop)
    spelled = lambda w: "".join(map(chr, points[start[w] : stop[w]]))
    if automaton.known:
        real = np.array([not e or spelled(w) not in automaton.known for w, e in zip(word, spent, strict=True)], bool)
        word, term, spent = word[real], term[real], spent[real]
    weight = automaton.weights[term] if len(term) else np.zeros(0)
    owner = text_of[word]
    head = np.searchsorted(text_of, np.arange(len(texts)))
    quoted, said, near = np.zeros(len(word)), np.zeros(len(word)), np.zeros(len(word))
    for k, w in enumerate(word):  # few: the hits
        low = max(head[owner[k]], w - WINDOW)
        high = min(w + WINDOW, head[owner[k]] + n_words[owner[k]] - 1)
        before, after = kind[start[low] : start[w]], kind[stop[w] : stop[high] + 1]
        quoted[k] = (before == _QUOTE).any() and (after == _QUOTE).any()
        said[k] = any(spelled(x) in SAYING for x in range(low, w))
        near[k] = np.searchsorted(word, high, "right") - np.searchsorted(word, low) - 1
    for name, v in (("hits", weight), ("exact", weight * (spent == 0)), ("fuzzy", weight * (spent > 0)), ("quoted", weight * quoted), ("said", weight * said), ("near", near)):
        out[:, FEATURES.index(name)] = np.log1p(np.bincount(owner, v, len(texts)))
    count = np.bincount(owner, minlength=len(texts))
    out[:, FEATURES.index("any")] = count > 0
    out[:, FEATURES.index("density")] = np.log1p(20 * count / np.maximum(n_words, 1))
    return out


@lru_cache(1 << 16)
def _family(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return () if word.isdigit() else (word, *(word[:p] + "*" for p in BEGINNINGS if len(word) > p))


def _terms(text: str) -> set[str]:
    return set(itertools.chain.from_iterable(map(_family, set(TOKEN.findall(text.lower())))))


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, 1) of each term of each sampled document."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for t in _terms(text or ""):
                counts[t, toxic] = counts.get((t, toxic), 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.int32()), pa.array(counts.values(), pa.int64())], ["term", "toxic", "n"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sampled_labels")
    return keep(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(chosen), "doc_id").select("text", "toxic"), "toxic_sample")


def likelihood(a: Column, b: Column, share: float) -> Column:
    """Log likelihood ratio of a toxic rows of a + b, against the share of toxic rows."""
    n, p = a + b, a / (a + b)
    return n * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))


def learn_terms(rows: DataFrame) -> tuple[list[tuple[str, bool, float]], frozenset[str], tuple[int, int]]:
    """The lexicon with log odds, words that are no misspelling of it, and the numbers of other and toxic rows."""
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    other, toxic = size.get(0, 0), size.get(1, 0)
    if not other or not toxic:
        return [], frozenset(), (other, toxic)
    counts = rows.select("text", "toxic").mapInArrow(_document_terms, "term string, toxic int, n long")
    per = keep(counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where(F.col("a") + F.col("b") >= LEAST_OTHERS), "term_counts")
    tried = per.where(F.col("a") + F.col("b") >= LEAST_ROWS).count()
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (other + 1.0))
    sure = per.where(F.col("a") >= LEAST_ROWS).withColumn("odds", odds).withColumn("gain", likelihood(F.col("a"), F.col("b"), toxic / (other + toxic)))
    # a part of the sample's terms, which is the model's size
    best = sure.where((F.col("odds") >= LEAST_ODDS) & (F.col("gain") >= math.log(max(2, tried)) - SLACK)).orderBy(F.col("gain").desc(), "term").collect()
    words = {r.term for r in best if not r.term.endswith("*")}
    chosen: list[tuple[str, bool, float]] = [(r.term, False, round(float(r.odds), 6)) for r in best if r.term in words]
    begun = {r.term[:-1]: r for r in best if r.term.endswith("*")}
    for stem, r in begun.items():
        # a longer term in nearly the same rows is surer, and a shorter beginning that is as sure says the same
        longer = any(x.term.startswith(stem) and x.term != r.term and x.a >= 0.9 * r.a and x.odds >= r.odds for x in best)
        shorter = any(stem[:k] in begun and begun[stem[:k]].odds >= r.odds - 0.3 for k in range(1, len(stem)))
        if not longer and not shorter:
            chosen.append((stem, True, round(float(r.odds), 6)))
    fuzzy = Automaton([t for t in chosen if not t[1] and len(t[0]) >= FUZZY_LENGTH])
    own = per.where((F.col("b") >= LEAST_OTHERS) & ~F.col("term").endswith("*")).select("term")
    known = own.mapInArrow(_near(fuzzy), "term string").collect() if fuzzy.terms else []
    discard(per)
    return chosen, frozenset(r.term for r in known), (other, toxic)


def _near(automaton: Automaton):
    """Words within an edit of a term, none itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
            stop = np.cumsum([len(w) for w in words])
            word, _, spent = automaton.match(automaton.code[points], stop - [len(w) for w in words], stop)
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in word[spent > 0]], pa.string())], ["term"])

    return run


Lexicon = tuple[list[tuple[str, bool, float]], frozenset[str]]


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _automaton(lexicon)
            at, _ = utf8(batch.column(0))
            for i, j in slices(at):
                found = features([x or "" for x in batch.column(0).slice(i, j - i).to_pylist()], automaton)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], ["x", "toxic"])

    return run


_automata: dict[tuple, Automaton] = {}


def _automaton(lexicon: Lexicon) -> Automaton:
    key = (tuple(lexicon[0]), lexicon[1])
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(*lexicon)
    return _automata[key]


def regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the bias first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, penalty)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, list[float]]:
    """(lexicon, weights with the bias first) from the labelled sample."""
    chosen = sample(docs, labels, rows)
    terms, known, (other, toxic) = learn_terms(chosen)
    if not terms:
        share = (toxic + 0.5) / (other + toxic + 1) if other or toxic else 0.5
        return ([], known), [math.log(share / (1 - share))] + [0.0] * len(FEATURES)
    # equal feature vectors are counted, so what reaches the driver is bounded by the sample
    held = chosen.mapInArrow(_features((terms, known)), "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    n = np.array([r["count"] for r in held])
    x, y = np.repeat(np.array([r.x for r in held]), n, axis=0), np.repeat(np.array([r.toxic for r in held], float), n)
    return (terms, known), [round(float(v), 9) for v in regression(x, y)]


def _score(lexicon: Lexicon, weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            automaton = _automaton(lexicon)
            at, _ = utf8(batch.column(1))
            for i, j in slices(at):
                x = features([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], automaton)
                score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score, pa.float64()), pa.array(x[:, FEATURES.index("hits")], pa.float64())], ["doc_id", "score", "hits"])

    return run


def score(docs: DataFrame, labels: DataFrame | None = None, model: tuple[Lexicon, list[float]] | None = None) -> DataFrame:
    """(doc_id, score, hits) of each document; hits: log of 1 and the sum of its hits' weights."""
    lexicon, weights = train(docs, labels) if model is None else model
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(lexicon, weights), f"doc_id {kind}, score double, hits double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
