"""Benchmark decontamination (operator 1).

The test items are indexed (BM25 impacts, with maxima for blocks of items) and every passage of
every document is a query. Items are held by length class; for class 2**c, passages of
2**(c + 1) words start every 2**c words, so an item that was copied whole lies whole in one
passage. A passage asks for all items whose score reaches ``SHARE`` of the score that the item
has with itself.

Block-max WAND runs for all passages of a batch at once, on sparse lists of (term, block, maximum):

1. Pivot: a passage's terms are put in order of their highest impact. Terms whose highest impacts
   add up to less than the class's least threshold can't lift an item over it without one of
   the others; a passage without another term is done.
2. Only the blocks in the lists of those other terms are visited (a shallow move); the maxima of
   these terms there and the highest impacts of the rest bound the block's scores.
3. Blocks that may reach their least threshold have the rest's maxima looked up; blocks that still
   may have their postings read (a deep move), and items that reach their own threshold are returned.

These are verified by words: half of the shingles of the question and half of the words of the
answer have to be in the passage. Where items have no answer column, the last sentence is taken.

Document frequencies and the mean length are those of all items. The index is held by tasks a
shard at a time: items are dealt to shards of ``SHARD_BYTES`` of text, which tasks read from the
shared folder, and the documents are read once for each shard. Scores don't depend on the shards.

Edge cases: items with null text or no word are never found; documents with null or empty text
have no passage; equal items are all returned. A document that meets an item in several passages
gives one row with the best of them. Null ids are kept as they are. Empty tables give an empty
result; other columns are ignored. Repeated documents give repeated rows, repeated items too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import Words, discard, held, keep, shingle_set, sizes, slices, table, utf8, windows, write_shards

K1, B = 1.2, 0.75
SHARE = 0.5
#: Items in a block of the index.
BLOCK = 8
WORDS = 5
LEAST_OVERLAP = 0.5
LEAST_CLASS = 4
SHARD_BYTES = 32 << 20
#: Pairs of passage and block whose postings are read at once.
PAIRS = 1 << 18


def parts(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence with two words or more is the answer."""
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x]
    for k in range(len(sentences) - 1, 0, -1):
        if len(" ".join(sentences[k:]).split()) >= 2:
            return " ".join(sentences[:k]), " ".join(sentences[k:])
    return text, text


def _hashes(text: str) -> np.ndarray:
    at, data = utf8(pa.array([text]))
    return Words(at, data).hash


def statistics(texts: list[str | None]) -> tuple[dict[int, int], int, float]:
    """(items with each word, items with a word, their mean length): what the index needs of all items."""
    df: dict[int, int] = {}
    lengths = []
    for words in (_hashes(t or "") for t in texts):
        if len(words):
            lengths.append(len(words))
            for x in np.unique(words).tolist():
                df[x] = df.get(x, 0) + 1
    return df, len(lengths), float(np.mean(lengths)) if lengths else 1.0


def _flat(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1 of all i, one after another."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Blocks of items with block maxima; items = [(item_id, text, question, answer)].

    ``of_all``: ``statistics`` of all items, if these are one shard of them.
    """

    def __init__(self, items: list[tuple], of_all: tuple[dict[int, int], int, float] | None = None):
        frequency, n_items, mean = of_all or statistics([x[1] for x in items])
        rows = []
        for item, text, question, answer in items:
            words = _hashes(text or "")
            if len(words):
                if question is None or answer is None:
                    question, answer = parts(text)
                rows.append((item, words, _hashes(question), _hashes(answer)))
        self.vocabulary, of_term = np.unique(np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.uint64), return_inverse=True)
        length = np.array([len(r[1]) for r in rows], float)
        owner = np.repeat(np.arange(len(rows)), length.astype(int))
        pairs, tf = np.unique(np.stack([of_term, owner]), axis=1, return_counts=True) if rows else (np.zeros((2, 0), int), np.zeros(0))
        term, item = pairs
        df = np.array([frequency[int(x)] for x in self.vocabulary], float)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1.0, mean)))
        own = np.bincount(item, impact, len(rows))
        size = np.maximum(LEAST_CLASS, np.ceil(np.log2(np.maximum(length, 1)))).astype(int)
        # items in order of class and threshold, so that the items of a block have like thresholds
        order = np.lexsort((own, size))
        place = np.empty(len(rows), int)
        place[order] = np.arange(len(rows))
        self.ids = [rows[k][0] for k in order]
        self.threshold = SHARE * own[order]
        self.question = [shingle_set(rows[k][2], WORDS) for k in order]
        self.question_words = [min(WORDS, len(rows[k][2])) for k in order]
        self.answer = [rows[k][3] for k in order]
        block_items: list[tuple[int, int]] = []
        spans = []
        size = size[order]
        for c in sorted(set(size.tolist())):
            at = np.flatnonzero(size == c)
            first = len(block_items)
            block_items += [(int(k), int(min(k + BLOCK, at[-1] + 1))) for k in range(at[0], at[-1] + 1, BLOCK)]
            spans.append((c, first, len(block_items)))
        block_of = np.zeros(len(rows), int)
        for k, (i, j) in enumerate(block_items):
            block_of[i:j] = k
        self.n_blocks = max(1, len(block_items))
        self.block_first = np.array([i for i, _ in block_items], int)
        self.least = np.array([self.threshold[i:j].min() for i, j in block_items])
        # postings in order of term and block; a run is those of one term in one block, with its maximum
        by = np.lexsort((place[item], term))
        self.posting_place, self.posting_impact = place[item[by]], impact[by]
        run = term[by] * self.n_blocks + block_of[self.posting_place]
        self.runs, first = np.unique(run, return_index=True)
        self.run_start = np.r_[first, len(run)]
        self.run_block = self.runs % self.n_blocks
        self.run_most = np.maximum.reduceat(self.posting_impact, first) if len(first) else np.zeros(0)
        #: Of each class: (c, first and last block, runs of each term in the class, its highest impact, least threshold).
        self.classes = []
        every = np.arange(len(self.vocabulary)) * self.n_blocks
        for c, low, high in spans:
            begin, end = np.searchsorted(self.runs, every + low), np.searchsorted(self.runs, every + high)
            top = np.zeros(len(self.vocabulary))
            inside = (self.run_block >= low) & (self.run_block < high)
            np.maximum.at(top, self.runs[inside] // self.n_blocks, self.run_most[inside])
            self.classes.append((c, begin, end - begin, top, float(self.least[low:high].min())))
        # direct addressing of terms by the low bits of their hashes, then an exact comparison
        self.bits = max(8, len(self.vocabulary).bit_length() + 4)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        low = (self.vocabulary & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        self.clash = bool(len(np.unique(low)) < len(low))
        self.slot[low] = np.arange(len(low))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for words that no item holds."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        t = self.slot[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        hit = (t >= 0) & (self.vocabulary[t] == hashes)
        if self.clash:  # terms that lost their slot to another
            rest = np.flatnonzero((t >= 0) & ~hit)
            k = np.searchsorted(self.vocabulary, hashes[rest])
            k[k == len(self.vocabulary)] = 0
            ok = self.vocabulary[k] == hashes[rest]
            t[rest[ok]] = k[ok]
            hit[rest[ok]] = True
        return np.where(hit, t, -1)

    def find_runs(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs of term and block have postings, their runs)."""
        if not len(self.runs):
            return np.zeros(0, int), np.zeros(0, int)
        want = term * self.n_blocks + block
        k = np.minimum(np.searchsorted(self.runs, want), len(self.runs) - 1)
        hit = np.flatnonzero(self.runs[k] == want)
        return hit, k[hit]

    def candidates(self, k: int, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose scores may reach the block's least threshold, of class number k.

        passage, term: the distinct terms of each passage, by passage; all of them occur in the class.
        """
        _, begin, runs, top, least = self.classes[k]
        slack = 1 - 1e-9
        order = np.lexsort((top[term], passage))
        passage, term = passage[order], term[order]
        sums = np.cumsum(top[term])
        head = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        before = np.repeat(sums[head] - top[term[head]], np.diff(np.r_[head, len(passage)]))
        free = sums - before < least * slack  # not enough without a term behind these
        rest = np.bincount(passage[free], top[term[free]], passage[-1] + 1 if len(passage) else 0)
        lead = ~free
        # shallow moves: the blocks of the leading terms
        n = runs[term[lead]]
        at = _flat(begin[term[lead]], n)
        key = np.repeat(passage[lead], n) * np.int64(self.n_blocks) + self.run_block[at]
        if not len(key):
            return np.zeros(0, int), np.zeros(0, int)
        order = np.argsort(key, kind="stable")
        key, most = key[order], self.run_most[at][order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, bound = key[head], np.add.reduceat(most, head)
        good = bound + rest[key // self.n_blocks] >= self.least[key % self.n_blocks] * slack
        key, bound = key[good], bound[good]
        # the maxima of the other terms in the blocks that are left
        where, what = passage[free], term[free]
        edge = np.searchsorted(where, np.arange((passage[-1] if len(passage) else -1) + 2))
        first, n = edge[key // self.n_blocks], np.diff(edge)[key // self.n_blocks]
        cell = np.repeat(np.arange(len(key)), n)
        hit, run = self.find_runs(what[_flat(first, n)], (key % self.n_blocks)[cell])
        bound = bound + np.bincount(cell[hit], self.run_most[run], len(key))
        key = key[bound >= self.least[key % self.n_blocks] * slack]
        return key // self.n_blocks, key % self.n_blocks

    def score(self, pair: np.ndarray, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, item, score) of the items whose score reaches their threshold.

        ``block`` is the block of each pair of passage and block; ``term`` are the distinct terms
        of the passage of ``pair``. Only the postings of a term that lie in the block are read.
        """
        hit, k = self.find_runs(term, block[pair])
        pair = pair[hit]
        n = self.run_start[k + 1] - self.run_start[k]
        at = _flat(self.run_start[k], n)
        cell = np.repeat(pair, n) * BLOCK + self.posting_place[at] - self.block_first[block[np.repeat(pair, n)]]
        total = np.bincount(cell, self.posting_impact[at], len(block) * BLOCK)
        found = np.flatnonzero(total)
        item = self.block_first[block[found // BLOCK]] + found % BLOCK
        good = total[found] >= self.threshold[item] * (1 - 1e-9)
        return found[good] // BLOCK, item[good], total[found][good]

    def search(self, words: Words) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of verified passages, best of each pair."""
        term = self.terms(words.hash)
        n_words = np.diff(words.first)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        inner = np.arange(len(words)) - words.first[:-1][text_of]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        known = np.flatnonzero(term >= 0)
        for number, (c, _, _, top, least) in enumerate(self.classes):
            step = 1 << c
            parts_of = np.maximum(1, -(-n_words // step))  # segments of each text
            begin = np.cumsum(parts_of) - parts_of
            segment = begin[text_of] + inner // step
            mine = known[top[term[known]] > 0]
            keys = np.unique(segment[mine] * np.int64(len(self.vocabulary)) + term[mine])
            seg, t = keys // len(self.vocabulary), keys % len(self.vocabulary)
            # passages of two segments; a text's last segment is a passage alone
            total = np.bincount(seg, top[t], int(parts_of.sum()) + 1)
            ends = np.zeros(len(total), bool)
            ends[begin + parts_of - 1] = True
            bound = total[:-1] + np.where(ends[:-1], 0, total[1:])
            passages = np.flatnonzero(bound >= least * (1 - 1e-9))
            if not len(passages):
                continue
            owner = np.repeat(np.arange(len(n_words)), parts_of)
            edge = np.searchsorted(seg, np.arange(len(total) + 1))
            second = np.where(ends[passages], passages, passages + 1)
            size = edge[second + 1] - edge[passages]
            both = np.unique(np.repeat(np.arange(len(passages)), size) * np.int64(len(self.vocabulary)) + t[_flat(edge[passages], size)])
            of, terms = both // len(self.vocabulary), both % len(self.vocabulary)
            at, blocks = self.candidates(number, of, terms)
            cut = np.searchsorted(of, np.arange(len(passages) + 1))
            for low in range(0, len(at), PAIRS):
                here, there = at[low : low + PAIRS], blocks[low : low + PAIRS]
                n = np.diff(cut)[here]
                found = self.score(np.repeat(np.arange(len(here)), n), terms[_flat(cut[here], n)], there)
                self._verify(words, found, passages[here], owner, begin, step, best)
        return [(k, i, *v) for (k, i), v in sorted(best.items())]

    def _verify(self, words: Words, found: tuple, passages: np.ndarray, owner: np.ndarray, begin: np.ndarray, step: int, best: dict) -> None:
        """Put the best verified passage of each text and item into ``best``."""
        for k, item, score in zip(*found, strict=True):
            p = passages[k]
            text = int(owner[p])
            start = words.first[text] + (p - begin[text]) * step
            own = words.hash[start : min(start + 2 * step, words.first[text + 1])]
            q = self.question[item]
            near = np.isin(q, windows(own, self.question_words[item])).mean() if len(q) else 0.0
            answered = np.isin(self.answer[item], own).mean() if len(self.answer[item]) else 0.0
            if near >= LEAST_OVERLAP and answered >= LEAST_OVERLAP:
                key = (text, int(item))
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (float(score), float(near), float(answered)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for each word of each item, and (null, length, 1) for each item with words."""
    for batch in batches:
        at, data = utf8(batch.column(0))
        for i, j in slices(at):
            words = Words(at[i : j + 1], data)
            n = np.diff(words.first)
            each = np.unique(np.stack([np.repeat(np.arange(j - i), n).astype(np.uint64), words.hash]), axis=1)[1]
            word, df = np.unique(each, return_counts=True)
            items = int((n > 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([None, *word.view(np.int64).tolist()], pa.int64()), pa.array([items, *df.tolist()], pa.int64()), pa.array([int(n.sum()), *[0] * len(df)], pa.int64())], ["word", "n", "words"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = utf8(batch.column(1))
        words = [np.unique(Words(at[k : k + 2], data).hash).view(np.int64) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["n", "words"])


def _build(shard: pa.Table | None) -> Index | None:
    """The index of a shard: rows of items, each with the frequencies of its words in all items."""
    if shard is None or not shard.num_rows:
        return None
    df: dict[int, int] = {}
    for words, n in zip(shard.column("words").to_pylist(), shard.column("df").to_pylist(), strict=True):
        df.update(zip((w & 0xFFFFFFFFFFFFFFFF for w in words), n, strict=True))
    items = list(zip(*(shard.column(c).to_pylist() for c in ("item_id", "text", "question", "answer")), strict=True))
    return Index(items, (df, shard.column("n_items")[0].as_py(), shard.column("mean")[0].as_py()))


def shards(items: DataFrame, most: int = SHARD_BYTES) -> list[str]:
    """The items in shards of about ``most`` bytes of text, with the statistics of all items; see ``read_shard``."""
    columns = [F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("question", "answer")]
    numbered = keep(items.select(F.monotonically_increasing_id().alias("n"), "item_id", F.col("text").cast("string").alias("text"), *columns).where("text is not null"), "items")
    counts = keep(numbered.select("text").mapInArrow(_count_words, "word long, n long, words long").groupBy("word").agg(F.sum("n").alias("df"), F.sum("words").alias("words")), "item_words")
    total = counts.where("word is null").select("df", "words").first()
    n_items, length = (total.df, total.words) if total else (0, 0)
    each = numbered.select("n", "text").mapInArrow(_item_words, "n long, words array<long>").select("n", F.explode("words").alias("word"))
    known = each.join(counts.where("word is not null").select("word", "df"), "word").groupBy("n").agg(F.collect_list(F.struct("word", "df")).alias("w"))
    rows = numbered.join(known, "n").select("n", "item_id", "text", "question", "answer", F.col("w.word").alias("words"), F.col("w.df").alias("df"), F.lit(n_items).cast("long").alias("n_items"), F.lit(length / max(1, n_items)).alias("mean"))
    uris = write_shards(rows, "item_shards", sizes(numbered, F.octet_length("text"))[1], most, F.col("n"), ["n"])
    discard(numbered, counts)
    return uris


def _hits(uri: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = held(uri, _build)
            if index is None:
                continue
            at, data = utf8(batch.column(1))
            for i, j in slices(at):
                found = index.search(Words(at[i : j + 1], data))
                if found:
                    text, item, score, near, answered = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + int(k) for k in text])), pa.array([index.ids[k] for k in item], item_type), *(pa.array(x, pa.float64()) for x in (score, near, answered))],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def contaminated(docs: DataFrame, items: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item that it holds."""
    from pyspark.sql.pandas.types import to_arrow_type

    doc, item = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {doc.simpleString()}, item_id {item.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = None
    for uri in shards(items, most):
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_hits(uri, to_arrow_type(item)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _clean(uri: str, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = held(uri, _build)
            at, data = utf8(batch.column(at_text))
            for i, j in slices(at):
                found = {int(x[0]) for x in index.search(Words(at[i : j + 1], data))} if index else set()
                kept = [k for k in range(i, j) if k - i not in found]
                if kept:
                    yield batch.take(pa.array(kept))

    return run


def clean(docs: DataFrame, items: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for uri in shards(items, most):
        docs = docs.mapInArrow(_clean(uri, docs.columns.index("text")), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
