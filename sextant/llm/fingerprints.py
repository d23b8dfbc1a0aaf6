"""Fingerprints of documents as invertible Bloom lookup tables (operator 13).

A text is a multiset of paragraph parts: its lines, long ones cut after words whose hash says so
(a word in ``PART_WORDS`` or so) and after twice as many words at most, so that an edit changes the
parts around it and no others. A part's key is the hash of its words and of how often the text had it before. The sketch is a table of cells, each
with the count, the XOR of the keys and the XOR of their checksums; a key sits in ``HASHES`` cells. Sketches of
two versions are subtracted cell by cell, then peeled: a cell that holds one key gives it away,
the key leaves its other cells, and so on, until the keys that only one version has are found.

Tables have a power of two of cells and fold to any smaller one. A comparison starts small and
retries with twice the cells when peeling fails; tables are made so large (again by doubling) that
each of them can be peeled by itself, so the last retry, both keys' lists, never fails. Texts of up to
``FINE_CHARS`` code points have a second table of finer parts (a word in ``FINE_WORDS``), which
two such texts are compared by. The likeness is the share of equal parts among all parts of both.

``of_next`` compares each document with its edited version and with the next document: ids and
hashes give ranges, each text is shuffled once to its range, and the first text of a range goes
to the range before it as well.

Edge cases: a null text is empty. Texts without words have no parts and are alike (1.0) among themselves, and
unlike (0.0) all others. Null ids come before all others; rows of one doc_id are in order of
a hash of their text, and equal rows are interchangeable (a run of them is dealt over several ranges). After
the last row comes the first, so a single row is its own next. An empty table gives an empty result; texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import SLICE_BYTES, WHITE_SPACE, _hash_words, keep, mix, table

PART_WORDS, FINE_WORDS, FINE_CHARS = 32, 4, 1024
HASHES = 4
LEAST_CELLS, FIRST_CELLS = 8, 16
#: Cells for each key of a table that is likely to be peeled.
ROOM = 1.4
#: Keys for each range from which the borders of ranges are chosen.
SAMPLE_KEYS = 100

_U = np.uint64
_rng = np.random.default_rng(13)
_SEED = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_CHECK, _AGAIN, _STEP = (x | _U(1) for x in _rng.integers(1, 1 << 63, 3, dtype=np.uint64))


@dataclass
class Sketch:
    """Cells of a table over ``n`` keys."""

    n: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.count)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, whether a line starts) of each word."""
    hashes, owners, starts = [], [], []
    for i, piece, fresh in _pieces(texts):
        at = np.cumsum([0, *map(len, piece)])
        data = np.frombuffer(b"".join(piece), np.uint8)
        h, first = _hash_words(at, data, False)
        owner = np.searchsorted(at, first, "right") - 1
        line = np.cumsum(data == 10)[first] if len(first) else np.zeros(0, np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
        if len(h) and not fresh:
            new[0] = line[0] > 0
        hashes.append(h)
        owners.append(owner + i)
        starts.append(new)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(owners), np.concatenate(starts)) if hashes else (none, none.astype(np.int64), none.astype(bool))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], bool]]:
    """Runs of texts of about SLICE_BYTES: (first text's number, texts, whether they start anew); longer texts are cut at white space."""
    space = WHITE_SPACE.encode()
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > SLICE_BYTES:
            yield first, held, True
            held, size, first = [], 0, i
        if len(t) <= 2 * SLICE_BYTES:
            held.append(t)
            size += len(t)
            continue
        if held:
            yield first, held, True
        begin = 0
        while begin < len(t):
            end = min(begin + SLICE_BYTES, len(t))
            while end < len(t) and t[end] not in space:
                end += 1
            yield i, [t[begin:end]], begin == 0
            begin = end
        held, size, first = [], 0, i + 1
    if held:
        yield first, held, True


def _places(begin: np.ndarray) -> np.ndarray:
    """How far each entry is behind the last one that begins something; the first one does."""
    at = np.flatnonzero(begin)
    return np.arange(len(begin)) - np.repeat(at, np.diff(np.r_[at, len(begin)]))


def part_keys(texts: list[bytes], words: int, of: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """The keys of each text's parts."""
    h, owner, new = of if of is not None else _words(texts)
    if not len(h):
        return [np.zeros(0, np.uint64)] * len(texts)
    begin = new.copy()
    begin[1:] |= h[:-1] % _U(words) == 0
    place = _places(begin) % (2 * words)
    at = np.flatnonzero(place == 0)
    power = np.multiply.accumulate(np.r_[_U(1), np.full(int(place.max()), _STEP, np.uint64)])
    digest, owner = mix(np.add.reduceat(h * power[place], at)), owner[at]
    order = np.lexsort((digest, owner))
    d, o = digest[order], owner[order]
    fresh = np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1])]
    keys = mix(d + _places(fresh).astype(np.uint64) * _AGAIN)
    return np.split(keys, np.searchsorted(o, np.arange(1, len(texts))))


def _checksum(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _CHECK) >> _U(32)).astype(np.uint32)


def _cell(keys: np.ndarray, j: int, cells: int) -> np.ndarray:
    """The key's cell in the j-th part of a table; a table of half the cells has it at the same place but for the top bit."""
    own = cells // HASHES
    return (mix(keys ^ _SEED[j]) & _U(own - 1)).astype(np.int64) + j * own


def _tables(keys: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of some key lists, a row for each."""
    n = len(keys)
    count, key, check = np.zeros(n * cells, np.int32), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(n) * cells, [len(k) for k in keys])
    sums = _checksum(flat)
    for j in range(HASHES):
        at = base + _cell(flat, j, cells)
        np.add.at(count, at, np.int32(1))
        np.bitwise_xor.at(key, at, flat)
        np.bitwise_xor.at(check, at, sums)
    return count.reshape(n, cells), key.reshape(n, cells), check.reshape(n, cells)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a table came apart, table, key, sign of each key found) of tables in rows, which are used up."""
    n, cells = count.shape
    found: list[tuple] = []
    flat = [x.reshape(-1) for x in (count, key, check)]
    for _ in range(4 * cells + 8):
        row, at = np.nonzero(np.abs(count) == 1)
        own = key[row, at]
        pure = check[row, at] == _checksum(own)
        row, own, sign = row[pure], own[pure], count[row, at][pure]
        if not len(row):
            break
        order = np.lexsort((own, row))
        row, own, sign = row[order], own[order], sign[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (own[1:] != own[:-1])]
        row, own, sign = row[first], own[first], sign[first]
        found.append((row, own, sign))
        sums = _checksum(own)
        for j in range(HASHES):
            to = row * cells + _cell(own, j, cells)
            np.subtract.at(flat[0], to, sign)
            np.bitwise_xor.at(flat[1], to, own)
            np.bitwise_xor.at(flat[2], to, sums)
    done = ~((count != 0).any(axis=1) | (key != 0).any(axis=1) | (check != 0).any(axis=1))
    rows, keys, signs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return done, rows, keys, signs


def _least(n: float) -> int:
    cells = LEAST_CELLS
    while cells < n:
        cells *= 2
    return cells


def sketches(keys: list[np.ndarray]) -> list[Sketch]:
    """The table of each key list, doubled until it can be peeled."""
    out: list[Sketch | None] = [None] * len(keys)
    todo = defaultdict(list)
    for i, k in enumerate(keys):
        todo[_least(ROOM * len(k))].append(i)
    while todo:
        cells = min(todo)
        own = todo.pop(cells)
        made = _tables([keys[i] for i in own], cells)
        done, *_ = peel(*(x.copy() for x in made))
        for row, i in enumerate(own):
            if done[row]:
                out[i] = Sketch(len(keys[i]), *(x[row] for x in made))
            else:
                todo[2 * cells].append(i)
    return out


def folded(s: Sketch, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table with fewer cells."""
    parts = [x.reshape(HASHES, s.cells // cells, cells // HASHES) for x in (s.count, s.key, s.check)]
    return parts[0].sum(axis=1, dtype=np.int32).ravel(), np.bitwise_xor.reduce(parts[1], axis=1).ravel(), np.bitwise_xor.reduce(parts[2], axis=1).ravel()


def differences(pairs: list[tuple[Sketch, Sketch]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys that only the first, and only the second, of two sketches has."""
    out: list[tuple | None] = [None] * len(pairs)
    todo = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        todo[max(FIRST_CELLS, _least(abs(a.n - b.n)))].append(i)
    whole: list[int] = []
    while todo:
        cells = min(todo)
        own = todo.pop(cells)
        fit = [i for i in own if cells <= min(pairs[i][0].cells, pairs[i][1].cells)]
        whole += [i for i in own if cells > min(pairs[i][0].cells, pairs[i][1].cells)]
        if not fit:
            continue
        a, b = ([np.stack(x) for x in zip(*(folded(pairs[i][side], cells) for i in fit), strict=True)] for side in (0, 1))
        done, rows, keys, signs = peel(a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
        edge = np.argsort(rows, kind="stable")
        rows, keys, signs = rows[edge], keys[edge], signs[edge]
        first = np.searchsorted(rows, np.arange(len(fit) + 1))
        for row, i in enumerate(fit):
            if done[row]:
                k, s = keys[first[row] : first[row + 1]], signs[first[row] : first[row + 1]]
                out[i] = (k[s > 0], k[s < 0])
            else:
                todo[2 * cells].append(i)
    if whole:
        lists = keys_of([s for i in whole for s in pairs[i]])
        for k, i in enumerate(whole):
            a, b = lists[2 * k], lists[2 * k + 1]
            out[i] = (np.setdiff1d(a, b), np.setdiff1d(b, a))
    return out


def keys_of(some: list[Sketch]) -> list[np.ndarray]:
    """All keys of each sketch."""
    out: list[np.ndarray | None] = [None] * len(some)
    by_cells = defaultdict(list)
    for i, s in enumerate(some):
        by_cells[s.cells].append(i)
    for own in by_cells.values():
        _, rows, keys, _ = peel(*(np.stack([getattr(some[i], x) for i in own]) for x in ("count", "key", "check")))
        edge = np.argsort(rows, kind="stable")
        first = np.searchsorted(rows[edge], np.arange(len(own) + 1))
        for row, i in enumerate(own):
            out[i] = keys[edge][first[row] : first[row + 1]]
    return out


@dataclass
class Fingerprint:
    digest: bytes
    coarse: Sketch
    fine: Sketch | None

    def __str__(self) -> str:
        """Base64 of the text's digest (8 bytes) and its tables: cells, keys, counts, key and checksum XORs."""
        out = [self.digest]
        for s in (self.coarse, self.fine):
            if s is not None:
                out += [struct.pack("<BI", s.cells.bit_length(), s.n), s.count.astype("<i4").tobytes(), s.key.astype("<u8").tobytes(), s.check.astype("<u4").tobytes()]
        return base64.b64encode(b"".join(out)).decode()


def parsed(text: str) -> Fingerprint:
    """The fingerprint of its string."""
    data = base64.b64decode(text)
    tables, at = [], 8
    while at < len(data):
        bits, n = struct.unpack_from("<BI", data, at)
        cells, at = 1 << bits - 1, at + 5
        arrays = []
        for kind, size in (("<i4", 4), ("<u8", 8), ("<u4", 4)):
            arrays.append(np.frombuffer(data, kind, cells, at).astype(kind[1:]))
            at += cells * size
        tables.append(Sketch(n, *arrays))
    return Fingerprint(data[:8], tables[0], tables[1] if len(tables) > 1 else None)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    data = [t.encode() for t in texts]
    coarse = sketches(part_keys(data, PART_WORDS, of := _words(data)))
    short = [i for i, t in enumerate(texts) if len(t) <= FINE_CHARS]
    inside = np.zeros(len(texts), np.int64) - 1
    inside[short] = np.arange(len(short))
    own = inside[of[1]] >= 0
    fine = dict(zip(short, sketches(part_keys([data[i] for i in short], FINE_WORDS, (of[0][own], inside[of[1][own]], of[2][own]))), strict=True))
    return [Fingerprint(hashlib.sha256(d).digest()[:8], c, fine.get(i)) for i, (d, c) in enumerate(zip(data, coarse, strict=True))]


def compared(a: list[Fingerprint], b: list[Fingerprint]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(likeness, keys of the first alone, keys of the second alone) of pairs of fingerprints."""
    pairs = [(x.fine, y.fine) if x.fine is not None and y.fine is not None else (x.coarse, y.coarse) for x, y in zip(a, b, strict=True)]
    out = []
    for (x, y), (gone, come) in zip(pairs, differences(pairs), strict=True):
        apart = len(gone) + len(come)
        out.append(((x.n + y.n - apart) / (x.n + y.n + apart) if x.n + y.n else 1.0, gone, come))
    return out


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _spans(texts := [x or "" for x in batch.column(1).to_pylist()]):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(str, fingerprints(texts[i:j])), pa.string())], ["doc_id", "fingerprint"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_of_texts, "doc_id long, fingerprint string")


def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            found = compared(*([parsed(x) for x in part.column(k).to_pylist()] for k in (1, 2)))
            keys = [pa.array([x[k].astype(np.int64) for x in found], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.float64()), *keys], ["doc_id", "likeness", "removed", "added"])


def versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, likeness, removed, added) of documents in two tables of fingerprints: parts by their keys."""
    both = old.select("doc_id", F.col("fingerprint").alias("a")).join(new.select("doc_id", F.col("fingerprint").alias("b")), "doc_id")
    return both.mapInArrow(_of_pairs, "doc_id long, likeness double, removed array<long>, added array<long>")


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as many code points of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SLICE_BYTES of code points, or one text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > SLICE_BYTES:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


Key = tuple[int, int, int]


def _keys(batch: pa.RecordBatch) -> list[Key]:
    """(whether there is an id, id, hash) of rows that begin with doc_id and hash."""
    return [(0, 0, h) if d is None else (1, d, h) for d, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]


def _firsts(borders: list[Key]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, Key] = {}
        for batch in batches:
            for key in _keys(batch):
                at = bisect_right(borders, key)
                if at not in least or key < least[at]:
                    least[at] = key
        columns = [pa.array([v[k] for v in least.values()], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int32()), *columns], ["part", "f", "d", "h"])

    return run


def _dealt(borders: list[Key], tails: dict[Key, list[int]]):
    """(part, tail, f, doc_id, h, text): each row to its range, and the first row of a range to those before it as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[Key, int] = {}
        sent: set[Key] = set()
        for batch in batches:
            rows, parts, tail = [], [], []
            for i, key in enumerate(keys := _keys(batch)):
                low, high = bisect_left(borders, key), bisect_right(borders, key)
                if high - low > 1:  # copies that fill ranges: the last range has one at least
                    turn[key] = turn.get(key, 0) + 1
                    high -= (turn[key] - 1) % (high - low)
                rows.append(i)
                parts.append(high)
                tail.append(False)
                if key in tails and key not in sent:
                    sent.add(key)
                    rows += [i] * len(tails[key])
                    parts += tails[key]
                    tail += [True] * len(tails[key])
            at = pa.array(rows, pa.int64())
            known = pa.array([keys[i][0] for i in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(tail, pa.bool_()), known, *(batch.column(k).take(at) for k in range(3))], ["part", "tail", "f", "doc_id", "h", "text"])

    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then the row after it."""
    held: tuple[int | None, str, Fingerprint] | None = None
    for batch in batches:
        over = batch.column(0).to_pylist()
        n = over.index(True) + 1 if True in over else len(over)
        ids, texts = batch.column(1).to_pylist()[:n], [x or "" for x in batch.column(2).to_pylist()[:n]]
        for i, j in _spans(texts):
            made = fingerprints(texts[i:j])
            rows = ([held] if held else []) + list(zip(ids[i:j], texts[i:j], made, strict=True))
            if len(rows) > 1:
                changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)]
                new = fingerprints(changed)
                own, following = [r[2] for r in rows[:-1]], [r[2] for r in rows[1:]]
                columns = [[r[0] for r in rows[:-1]], [len(r[1]) for r in rows[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in changed], list(map(str, own)), list(map(str, new))]
                columns += [[x[0] for x in compared(own, y)] for y in (new, following)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)
            held = rows[-1]
        if n < len(over) or over and over[-1]:
            return


def of_next(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited version (see ``edited``), and its likeness to that and to the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    spark = docs.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = keep(rows.select("doc_id", "h"), "keys")
    n = keys.count()
    some = sorted((int(r[0] is not None), r[0] or 0, r[1]) for r in keys.sample(min(1.0, SAMPLE_KEYS * tasks / max(n, 1)), 13).collect())
    borders = [some[len(some) * k // tasks] for k in range(1, tasks)] if some else []
    least = keys.mapInArrow(_firsts(borders), "part int, f long, d long, h long").groupBy("part").agg(F.min(F.struct("f", "d", "h")).alias("x")).collect()
    firsts = {r.part: tuple(r.x) for r in least}
    tails: dict[Key, list[int]] = defaultdict(list)
    following = firsts[min(firsts)] if firsts else None
    for part in range(tasks - 1, -1, -1) if firsts else ():
        tails[following].append(part)
        following = firsts.get(part, following)
    dealt = rows.mapInArrow(_dealt(borders, dict(tails)), "part int, tail boolean, f int, doc_id long, h long, text string")
    ordered = dealt.repartitionById(tasks, "part").sortWithinPartitions("tail", "f", "doc_id", "h")
    return ordered.select("tail", "doc_id", "text").mapInArrow(_in_order, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_next(table(spark, sf_dir, "documents"))
