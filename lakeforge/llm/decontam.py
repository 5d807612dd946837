"""Benchmark decontamination: item-sized windows, SimHash, and exact confirmation.

A benchmark item of n words is looked for in every window of n words of every document.

1. Windows are compared by their shingles of SHINGLE words (A-Z in lower case). Two equally long
   windows of m shingles with weighted similarity of PERCENT / 100 or more share at least
   2p / (1 + p) * m of them, so windows with fewer shingles of items of their size are passed over;
   that loses nothing. A document shorter than an item is one window as a whole, held against the same
   bound for unequal sizes, both >= p / (1 + p) * (m + the item's shingles).
2. The others get a SimHash of BITS bits: each bit is the sign of the sum, over the window's
   shingles as often as they occur, of that bit of the shingle's hash as +1 or -1.
3. The items' fingerprints are indexed by BLOCKS blocks of BITS / BLOCKS bits. A window asks each block for its own
   value and all values up to FLIPS bits away. Two fingerprints within RADIUS = (FLIPS + 1) * BLOCKS - 1 bits have a
   block that differs in FLIPS bits at most, so the index returns every item within the radius: it is what
   says which items a window may hold.
4. Items within the radius are confirmed by the weighted Jaccard similarity of the shingle counts.

The benchmark is taken in blocks of at most BLOCK_BYTES of text; each block is a pass over the
documents, and no more than a block is sent to the executors. Documents stay where they are: there is no
shuffle, and a passage that a third of the corpus quotes costs no task more than its own share.

Items of fewer than SHINGLE words are one shingle, found where the same words stand. Null, empty and
wordless texts, of documents or items, match nothing. Repeated items are found under each of their ids.
Repeated documents are looked at one by one; a null doc_id or item_id is carried along.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, batch_words, keep, map_arrow, mix64, text_bytes, text_string

PERCENT = 75
BITS, BLOCKS = 128, 16
FLIPS = 2
RADIUS = (FLIPS + 1) * BLOCKS - 1
BLOCK_BYTES = 16 << 20

_FACTORS = mix64(np.arange(SHINGLE), 23) | np.uint64(1)
#: What a block's value is changed by to reach all values up to FLIPS bits away.
_FLIPS = np.array([x for x in range(1 << BITS // BLOCKS) if x.bit_count() <= FLIPS], np.int64)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` words that begins at each word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += mix64(h[k : n + k], k) * _FACTORS[k]
    return mix64(total, width)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, as BITS // 8 bytes."""
    words = np.stack([mix64(shingles, 31 + k) for k in range(BITS // 64)], axis=1)
    ones = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles))


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted intersection and union."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both, sum(a.values()) + sum(b.values()) - both


class Index:
    """One block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids, self.counts, self.prints = [], [], []
        by_length: dict[int, list[np.ndarray]] = {}
        keys, values = [], []
        for item_id, text in items:
            h = hashes(text.lower().split())
            if not len(h):
                continue
            n, k = len(h), len(self.ids)
            s = runs(h, min(SHINGLE, n))
            fp = simhash(s)
            self.ids.append(item_id)
            self.counts.append(Counter(s.tolist()))
            self.prints.append(fp)
            by_length.setdefault(n, []).append(s)
            for block, value in enumerate(fp.tolist()):
                keys.append(self._key(n, block, value))
                values.append(k)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.lengths = {n: np.unique(np.concatenate(x)) for n, x in sorted(by_length.items())}
        # Whether any item has a shingle: flags tell most others apart (64 flags a shingle, 16 MB at most), the list the rest.
        long = [x for n, x in self.lengths.items() if n >= SHINGLE]
        self.every = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        self.mask = np.uint64((1 << min(24, max(10, int(64 * len(self.every)).bit_length()))) - 1)
        self.flags = np.zeros(int(self.mask) + 1, bool)
        self.flags[self.every & self.mask] = True
        self.least = min((-(-PERCENT * (n - SHINGLE + 1) // 100) for n in self.lengths if n >= SHINGLE), default=1 << 62)

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """The places of the shingles that some item has."""
        at = np.flatnonzero(self.flags[shingles & self.mask])
        return at[np.isin(shingles[at], self.every)]

    @staticmethod
    def _shingles(n: int) -> int:
        return max(min(n, 1), n - SHINGLE + 1)

    @staticmethod
    def _key(n: int, block: int, value: int) -> int:
        return (n * BLOCKS + block) << 8 | value

    def within(self, n: int, fp: np.ndarray) -> set[int]:
        """The items of n words whose fingerprints are within RADIUS."""
        keys = np.concatenate([self._key(n, b, 0) | (v ^ _FLIPS) for b, v in enumerate(fp.tolist())])
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        near = {int(k) for a, b in zip(lo, hi, strict=True) if a < b for k in self.values[a:b]}
        return {k for k in near if int(np.unpackbits(fp ^ self.prints[k]).sum()) <= RADIUS}

    def find(self, h: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity) of the best window of each item found, in the words' hashes."""
        best: dict[int, tuple] = {}
        s5 = runs(h, SHINGLE)
        hot = self.known(s5)
        for n, known in self.lengths.items():
            if n > len(h):
                # The text as a whole is the window; it holds ``size`` shingles, and the item ``most``.
                size, most = self._shingles(len(h)), self._shingles(n)
                if not size or 100 * size < PERCENT * most:
                    break  # longer items share even less
                s, m = (s5, size) if len(h) >= SHINGLE else (runs(h, len(h)), 1)
                places = np.zeros(int((100 + PERCENT) * np.isin(s, known).sum() >= PERCENT * (size + most)), np.int64)
            elif n < SHINGLE:
                s = runs(h, n)
                places, m = np.flatnonzero(np.isin(s, known)), 1
            else:
                m = n - SHINGLE + 1
                # |A & B| >= p / (100 + p) * (|A| + |B|)
                if len(hot) * (100 + PERCENT) < 2 * PERCENT * m:
                    continue
                s = s5
                own = hot[np.isin(s[hot], known)]
                if len(own) * (100 + PERCENT) < 2 * PERCENT * m:
                    continue
                # Windows whose first shingle is at i hold those of own in [i, i + m).
                total = np.zeros(len(s) + 1, np.int64)
                total[own + 1] = 1
                np.cumsum(total, out=total)
                held = total[m:] - total[:-m]
                places = np.flatnonzero(held * (100 + PERCENT) >= 2 * PERCENT * m)
            for at in places.tolist():
                window = s[at : at + m]
                fp = simhash(window)
                counts = None
                for k in self.within(n, fp):
                    counts = counts or Counter(window.tolist())
                    both, union = similarity(counts, self.counts[k])
                    if 100 * both >= PERCENT * union and both / union > best.get(k, (0, 0, 0, 0, 0.0))[4]:
                        best[k] = (k, at, min(n, len(h)), int(np.unpackbits(fp ^ self.prints[k]).sum()), both / union)
        return [best[k] for k in sorted(best)]


    def find_all(self, texts: pa.Array) -> list[tuple]:
        """(text, item, first word, words, Hamming distance, similarity) for a string column.

        Texts with fewer of the items' shingles than the shortest item needs are passed over at once.
        """
        place, ends, words = batch_words(pc.ascii_lower(texts))
        h = hashes(words.cast(pa.large_binary()).to_pylist())[place]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))

        def own(width: int, at: np.ndarray) -> np.ndarray:
            """The texts of the places whose words are all of one text."""
            return text[at[text[at] == text[at + width - 1]]]

        found = np.zeros(len(ends) - 1, bool)
        if len(h) >= SHINGLE:
            near = own(SHINGLE, self.known(runs(h, SHINGLE)))
            found |= np.bincount(near, minlength=len(found)) >= self.least
        for n, known in self.lengths.items():
            if n < SHINGLE and len(h) >= n:
                found[own(n, np.flatnonzero(np.isin(runs(h, n), known)))] = True
        return [(k, *m) for k in np.flatnonzero(found).tolist() for m in self.find(h[ends[k] : ends[k + 1]])]


def _index(sent) -> Index:
    """One index a Python worker and block, as long as its tasks are of this operator."""
    return keep("decontam", sent.name, lambda: Index(sent.broadcast.value))


class _Sent:
    """A broadcast block of items, known on executors by a name of its own."""

    def __init__(self, broadcast):
        self.broadcast, self.name = broadcast, uuid.uuid4().hex


def blocks(items: DataFrame, most: int = BLOCK_BYTES):
    """Lists of (item_id, text) with at most ``most`` bytes of text each, or one item."""
    block, size = [], 0
    for r in items.select("item_id", text_bytes().alias("text")).orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, hamming, similarity: the best window for each document and item within reach."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kinds}, item_id long, first_word long, n_words long, hamming int, similarity double"
    rows = docs.select("doc_id", text_string())
    out = None
    for block in blocks(items, most):
        sent = _Sent(spark.sparkContext.broadcast(block))

        def run(batches, sent=sent):
            index = _index(sent)
            for b in batches:
                found = index.find_all(b.column(1))
                at, k, first, n, far, near = zip(*found, strict=True) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([index.ids[x] for x in k], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(far, pa.int32()), pa.array(near, pa.float64())],
                    ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"],
                )

        part = map_arrow(rows, run, shape, owner="decontam")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], shape)


def clean(docs: DataFrame, items: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found, in the columns of ``docs``, which are carried in a struct and may have any name."""
    spark, columns = docs.sparkSession, docs.columns
    docs = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"))
    shape = docs.schema
    for block in blocks(items, most):
        sent = _Sent(spark.sparkContext.broadcast(block))

        def run(batches, sent=sent):
            index = _index(sent)
            for b in batches:
                clear = np.ones(b.num_rows, bool)
                clear[np.array([k for k, *_ in index.find_all(b.column(1))], np.int64)] = False
                yield b.select([0]).filter(pa.array(clear, pa.bool_()))

        docs = map_arrow(docs.select("row", text_string("row.text").alias("text")), run, shape, owner="decontam")
    return docs.select("row.*")
