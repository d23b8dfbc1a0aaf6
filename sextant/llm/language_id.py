"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton of labelled text holds every substring of that text. A
document is parsed against each automaton into the longest phrases that occur in it; few
phrases mean a close language. The phrase count is normalised by the log of the training
length and the number of symbols (the cross-parsing estimate of the relative entropy), and the
language with the least value wins; ties go to the smaller name.

Learned from ``SAMPLE_ROWS`` labelled rows for each language at most (those with the least
hashes), each by a window of it whose place is chosen by a hash. Windows are cut to one length so
that a language has ``SAMPLE_SYMBOLS`` symbols; every row teaches, and every letter keeps its own symbol. That bound is the model's size, not a limit on
what is predicted. Whole texts are parsed: blocks of ``BLOCK`` symbols of many texts run through the
automata at once, as NumPy lanes, and then each block's first phrases are read again as the
block before left them, until both readings agree. So the block's size doesn't change a result.

``limits`` tells known languages from others by the rate of phrases to symbols: automata of the
first half of each sample parse its second half as it is (the rate of that language) and with its
letters shuffled (the rate of unknown words of the same letters). A language's limit lies
between the two, ``LIMIT_AT`` of the way up. ``in_known_language`` allows ``SPARE_PHRASES`` more,
for names and the ends of short texts.

Edge cases: a null text or one without a letter gives ``und`` and score 0. If no labelled row
exists, every document is ``und``. Letters that the sample doesn't hold end each phrase in
every language alike. Rows are judged alone, so repeated rows get equal results; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.llm.common import discard, keep, slices, small, table, utf8

SAMPLE_ROWS = 64
SAMPLE_SYMBOLS = 20_000
#: Characters of a row's window, as a multiple of its even share: they make up for shorter rows.
WINDOW_SHARES = 8
BLOCK = 1024
#: Bytes of text that are parsed at once; a longer text is parsed piece by piece.
PIECE = 4 << 20
# Alphabet: 0 for runs of anything but letters, 1 for letters not in the sample, then its letters.

LIMIT_AT = 0.8
SPARE_PHRASES = 4


def held_out() -> Column:
    return F.expr("crc32(cast(doc_id as string)) % 3 = 1")


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, symbols: int = SAMPLE_SYMBOLS) -> dict[str, str]:
    """Text for each language, of at most ``rows`` rows and ``symbols`` letters or so."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", F.expr("pmod(xxhash64(doc_id), 1L << 62)").alias("h"))
    # where rows lie, only hashes below four times the share that is wanted stay: so no task gets a frequent language
    sizes = keep(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")), "languages")
    low = known.join(small(sizes), "lang").where(F.col("h") < F.lit(4.0 * rows * (1 << 62)) / F.col("ids")).select("doc_id", "lang", "h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = keep(low.withColumn("n", first).where(F.col("n") <= rows).select("doc_id", "lang"), "sampled_ids")
    discard(sizes)
    each = max(1, WINDOW_SHARES * symbols // rows)
    at = F.expr(f"cast(1 + pmod(xxhash64(doc_id, 2), greatest(length(text) - {each} + 1, 1)) as int)")
    texts = docs.select("doc_id", "lang", F.substr("text", at, F.lit(each)).alias("text")).where("text is not null").join(small(ids), ["doc_id", "lang"])
    found: dict[str, list[str]] = {}
    for r in sorted(texts.select("lang", "doc_id", "text").collect()):  # rows * languages windows at most
        found.setdefault(r.lang, []).append(r.text)
    return {k: "".join(x[: level(v, symbols)] + "\n" for x in v) for k, v in sorted(found.items())}


def level(texts: list[str], symbols: int) -> int:
    """The length to which texts are cut so that all of them together hold ``symbols`` at most."""
    left = symbols
    sizes = sorted(map(len, texts))
    for k, n in enumerate(sizes):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return sizes[-1]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Parser:
    """The automata of all languages in one hash table of transitions, by state and symbol."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        kept = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.code = np.zeros(0x110000, np.int32)
        self.code[self._alphabetic()] = 1
        for k, c in enumerate(kept):
            self.code[ord(c)] = k + 2
        self.n = len(kept) + 2
        keys, values, self.weight = [], [], []
        self.fresh = np.ones((len(self.langs), self.n), np.int32)
        size = 2  # state 0: none; state 1: one without a way on, before a phrase and after an unknown letter
        for i, lang in enumerate(self.langs):
            symbols = self.symbols(texts[lang])
            go = suffix_automaton(symbols.tolist())
            for k, x in enumerate(go):
                for c, to in x.items():
                    keys.append((k + size) * self.n + c)
                    values.append(to + size)
            for c, to in go[0].items():
                self.fresh[i, c] = to + size
            size += len(go)
            self.weight.append(np.log2(max(2, len(symbols))))
        self.weight = np.array(self.weight)
        self._fill(np.array(keys, np.int64), np.array(values, np.int32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with steps of one; an eighth to a quarter of the slots is taken."""
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol, 0 where there is no way on."""
        key = (state.astype(np.int64) * self.n + symbol).ravel()
        slot = self._slot(key)
        held = self.keys[slot]
        on = np.where(held == key, self.values[slot], 0)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == key[left]
            on[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return on.reshape(state.shape)

    @staticmethod
    def _alphabetic() -> np.ndarray:
        return np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of anything but letters as one 0."""
        x = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == 0) & (x[:-1] == 0)
        return x[~again]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (texts x languages), number of symbols, whether there is a letter."""
        if len(texts) != 1 or len(texts[0]) <= PIECE:
            return self._phrases([self.symbols(t) for t in texts])[:3]
        total, n, letter, state, last = np.zeros((1, len(self.langs))), 0, False, None, 1
        for k in range(0, len(texts[0]), PIECE):
            part = self.symbols(texts[0][k : k + PIECE])
            part = part[1:] if last == 0 and len(part) and part[0] == 0 else part  # a run of other signs goes on
            if len(part):
                count, size, found, state = self._phrases([part], state)
                total, n, letter, last = total + count, n + int(size[0]), letter or bool(found[0]), int(part[-1])
        return total, np.array([n]), np.array([letter])

    def _phrases(self, parts: list[np.ndarray], entering: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Of symbols, also the states in which the last text ends; ``entering``: those before the first one."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        letters = np.fromiter((bool(p.any()) for p in parts), bool, len(parts))
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(parts)), blocks)
        first = np.cumsum(n) - n
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[owner] + inner * BLOCK
        length = np.minimum(BLOCK, n[owner] - inner * BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        data = np.concatenate([*parts, np.zeros(1, np.int32)])
        active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks of more than t symbols
        g = len(self.langs)
        state = np.full((g, len(owner)), 1, np.int32)
        begins = np.zeros((BLOCK, g, len(owner)), bool)  # a phrase begins here, if one does at the block's start
        count = np.zeros((g, len(owner)), np.int64)
        for t in range(BLOCK):
            m = active[t]
            if not m:
                break
            c = data[start[:m] + t]
            on = self._next(state[:, :m], c)
            dead = on == 0
            begins[t, :, :m] = dead
            count[:, :m] += dead
            np.copyto(on, self.fresh[:, c], where=dead)
            state[:, :m] = on
        place = np.argsort(order)  # where the sorted lanes hold each block
        later = np.flatnonzero(inner > 0)
        before, after = place[later - 1], place[later]
        if entering is not None:  # as if an empty block came first
            state = np.c_[state, entering]
            before, after = np.r_[before, len(place)], np.r_[after, place[0]]
        self._go_on(data, start, length, before, after, state, begins, count)
        total = np.zeros((len(parts), g))
        for k in range(g):
            total[:, k] = np.bincount(owner, count[k], len(parts))
        return total, n, letters, state[:, place[-1]] if len(place) else entering

    def _go_on(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray, state: np.ndarray, begins: np.ndarray, count: np.ndarray) -> None:
        """Let phrases go on over the ends of blocks: ``after`` are the blocks that follow those of ``before``.

        A block is read again from the state in which the one before ended, until a phrase begins
        where one began in the first reading: from there on both readings agree. A block in which
        they never meet ends in another state, so the next one is read again, until no end changes.
        ``count`` and ``state`` (languages x blocks) are brought up to date.
        """
        g = len(self.langs)
        first, first_state = count.copy(), state.copy()
        follows = np.full(state.shape[1], -1)  # no block comes after it
        follows[before] = after
        lang, lane, prior = np.repeat(np.arange(g), len(after)), np.tile(after, g), np.tile(before, g)
        while len(lane):
            now = state[lang, prior]
            extra = np.zeros(len(lane), np.int64)  # phrases of the new reading less those of the first so far
            ends = first_state[lang, lane]
            on, of, where, t = np.arange(len(lane)), lang, lane, 0
            while len(on):
                c = data[start[where] + t]
                now = self._next(now, c)
                dead = now == 0
                np.copyto(now, self.fresh[of, c], where=dead)
                was = begins[t, of, where]
                extra[on] += dead.astype(np.int64) - was
                t += 1
                apart = ~(dead & was)
                stop = apart & (length[where] == t)
                ends[on[stop]] = now[stop]
                left = np.flatnonzero(apart & ~stop)
                on, of, where, now = on[left], of[left], where[left], now[left]
            count[lang, lane] = first[lang, lane] + extra
            changed = ends != state[lang, lane]
            state[lang[changed], lane[changed]] = ends[changed]
            prior, lang = lane[changed], lang[changed]
            lane = follows[prior]
            keep = lane >= 0
            lang, lane, prior = lang[keep], lane[keep], prior[keep]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, phrases for each symbol of the best language, symbols)."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.array([len(self.symbols(t)) for t in texts], np.int64)
        count, n, letters = self.phrases(texts)
        cost = count * self.weight
        best = cost.argmin(axis=1)
        least = cost.min(axis=1, keepdims=True)
        odds = np.exp(-(cost - least) / np.sqrt(least + 1))
        score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
        rate = count[np.arange(len(texts)), best] / np.maximum(n, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score, rate, n


def limits(model: dict[str, str]) -> dict[str, float]:
    """The highest phrase rate of texts in each language; 1, which all reach, for a sample of less than four blocks."""
    half = Parser({k: v[: len(v) // 2] for k, v in model.items()})
    out = {}
    for k, lang in enumerate(half.langs):
        rest = model[lang][len(model[lang]) // 2 :]
        shuffled = "".join(np.random.default_rng(0).permutation(list(rest)))
        rates = []
        for text in (rest, shuffled):
            count, n, _ = half.phrases([text[i : i + BLOCK] for i in range(0, len(text), BLOCK)])
            rates.append(float(np.median(count[:, k] / np.maximum(n, 1))) if len(n) else 1.0)
        out[lang] = rates[0] + LIMIT_AT * max(0.0, rates[1] - rates[0]) if len(model[lang]) >= 4 * BLOCK else 1.0
    return out


def in_known_language(limit: dict[str, float]) -> Column:
    """Whether a row of ``identify`` has a letter and a phrase rate within its language's limit."""
    if not limit:
        return F.lit(False)
    most = F.try_element_at(F.create_map(*(F.lit(x) for pair in limit.items() for x in pair)), F.col("lang_pred"))
    return (F.col("lang_pred") != "und") & (F.col("phrase_rate") * F.col("n_symbols") <= F.coalesce(most, F.lit(1.0)) * F.col("n_symbols") + SPARE_PHRASES)


_parsers: dict[tuple, Parser] = {}


def _parser(texts: dict[str, str]) -> Parser:
    key = tuple(texts.items())
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts)
    return _parsers[key]


def _predict(texts: dict[str, str], at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        for batch in batches:
            at, _ = utf8(batch.column(at_text))
            for i, j in slices(at, PIECE):
                part = batch.slice(i, j - i)
                lang, score, rate, n = parser.predict([x or "" for x in part.column(at_text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(n, pa.int64())], [*part.schema.names, "lang_pred", "score", "phrase_rate", "n_symbols"])

    return run


def identify(docs: DataFrame, model: dict[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of docs with (lang_pred, score, phrase_rate, n_symbols) of their text.

    ``model``: sample texts by language, of ``sample(docs)`` if none is given.
    """
    model = sample(docs) if model is None else model
    carry = carry or ["doc_id"]
    columns = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = StructType(list(columns.schema.fields)).add("lang_pred", "string").add("score", "double").add("phrase_rate", "double").add("n_symbols", "long")
    return columns.mapInArrow(_predict(model, len(carry)), schema).drop("_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
