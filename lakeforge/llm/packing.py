"""Packing along a space-filling curve.

1. Each text becomes token ids, with END last (``token_rows``). Words repeat, so ids are cached
   by the piece of text between white space; the tokenizer never joins pieces across it.
2. The ids are hashed into a signed, unit-length vector of BUCKETS counts, projected to DIMS
   dimensions by a fixed Gaussian matrix, and the cell of the projection gets its place on a
   Hilbert curve (``hilbert``).
3. Documents are range-sorted by that place, ties by a hash of the document, and each range is cut
   into sequences of exactly LENGTH tokens, so neighbours along the curve share sequences.
4. What is left at the end of a range is cut into sequences whose lengths are powers of two. Such
   sequences need no padding, so none is made.

A null or empty text is END alone; a null doc_id is kept. Repeated rows are packed one by one. Extra columns are left out.
The state of a task is one sequence.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch_words, keep, map_arrow, mix64, range_count, text_string

LENGTH = 2048
END = 1
BUCKETS, DIMS, BITS = 256, 4, 15
CACHE = 1_000_000
#: Bytes of ids in a range, at least and at most.
RANGE_BYTES = 8 << 20, 256 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts as little-endian bytes, two bytes an id if the vocabulary allows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}
        # Tokens that end a word: words of letters alone can be encoded together and told apart again.
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: set[bytes]) -> None:
        """Put the words into the cache."""
        cache, letters, marked, odd = self.cache, {}, [], []
        for w in words:
            s = w.decode()
            if s.isalpha():
                letters[w] = s
            elif s[-1] in ".,|!?;:" and s[:-1].isalpha():
                # A word and the mark behind it are separate tokens, and the word alone is seen more often.
                stem = w[:-1]
                marked.append(w)
                if stem not in cache:
                    letters[stem] = s[:-1]
            else:
                odd.append(w)
        if letters:
            ids = self._ids(" ".join(letters.values()))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
                for k, w in enumerate(letters):
                    cache[w] = raw[at[k] : at[k + 1]]
            else:
                odd += letters
        for w in odd:
            cache[w] = self._ids(w.decode()).tobytes()
        for w in marked:
            mark = w[-1:]
            if mark not in cache:
                cache[mark] = self._ids(mark.decode()).tobytes()
            cache[w] = cache[w[:-1]] + cache[mark]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column, END last."""
        low = pc.ascii_lower(texts)
        # Special tokens are matched before letters change case, so such texts keep theirs.
        special = pc.match_substring(texts, "<|")
        place, ends, words = batch_words(pc.if_else(special, texts, low))
        each = list(map(self.cache.get, words := words.cast(pa.large_binary()).to_pylist()))
        missing = {w for w, x in zip(words, each, strict=True) if x is None and w}
        if missing:
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = {w for w in words if w}
            self._learn(missing)
            each = list(map(self.cache.get, words))
        each = [x or b"" for x in each]
        table = np.frombuffer(b"".join(each), self.kind)
        length = np.array([len(x) for x in each], np.int64) // self.kind.itemsize
        start = np.cumsum(length) - length
        n = length[place]
        out_end = np.cumsum(n)
        ids = table[np.repeat(start[place] - (out_end - n), n) + np.arange(out_end[-1] if len(n) else 0)]
        bound = np.concatenate(([0], out_end))[ends]
        end = np.array([END], self.kind)
        return [np.concatenate((ids[bound[k] : bound[k + 1]], end)) for k in range(len(ends) - 1)]

    def __call__(self, text: bytes) -> bytes:
        return self.batch(pa.array([text.decode()]))[0].tobytes()


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, as long as its tasks are of this operator."""
    return keep("packing", path, lambda: Encoder(path))


def id_kind(path: str) -> np.dtype:
    """Two bytes an id if the vocabulary allows; the tokenizer isn't kept."""
    return Encoder(path).kind


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (integers below 2**bits), by Skilling's transform."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x0 = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
            x[0] = x0
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Projector:
    """Hashed, unit-length vectors of token ids, projected and put into cells of equal share."""

    def __init__(self, seed: int = 11):
        self.matrix = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
        ids = mix64(np.arange(1 << 16), seed)
        self.bucket = (ids % np.uint64(BUCKETS)).astype(np.int64)
        self.sign = np.where(ids >> np.uint64(63), 1.0, -1.0)

    def vector(self, ids: np.ndarray) -> np.ndarray:
        ids = ids & 0xFFFF
        v = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=BUCKETS)
        return v / max(1e-9, float(np.sqrt(v @ v)))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        # A logistic curve stands in for the normal distribution's, to spread the cells evenly.
        share = 1 / (1 + np.exp(-1.702 * (vectors @ self.matrix)))
        return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, place (on the curve), tie, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, project = encoder(path), Projector()
        for b in batches:
            ids = encode.batch(b.column(2))
            vectors = np.array([project.vector(x) for x in ids]).reshape(-1, BUCKETS)
            place = hilbert(project.cells(vectors), BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place, pa.int64()), b.column(1), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "place", "tie", "ids"])

    return map_arrow(docs.select("doc_id", F.xxhash64("doc_id").alias("tie"), text_string()), run, f"doc_id {kind}, place long, tie long, ids binary", rows=4000, owner="packing")


def _pieces(kind: np.dtype, length: int):
    width = kind.itemsize

    def crc(part: bytes) -> int:
        return zlib.crc32(np.frombuffer(part, kind).astype("<u4").tobytes())

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, start, ids, tokens of the document): the sequence being filled
        filled = 0

        def emit(rows, pieces):
            nonlocal number
            at = 0
            for doc_id, start, part, tokens in pieces:
                n = len(part) // width
                rows.append((doc_id, start, n, crc(part), tokens, number, at))
                at += n
            number += 1

        def batch(rows, like):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        like = None
        for b in batches:
            like = b.column(0).type
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens, start = len(ids) // width, 0
                while start < tokens:
                    n = min(tokens - start, length - filled)
                    held.append((doc_id, start, ids[start * width : (start + n) * width], tokens))
                    start, filled = start + n, filled + n
                    if filled == length:
                        emit(rows, held)
                        held, filled = [], 0
            yield batch(rows, like)
        rows = []
        while filled:
            size = 1 << (filled.bit_length() - 1)
            now, rest, room = [], [], size
            for doc_id, start, part, tokens in held:
                n = min(len(part) // width, room)
                if n:
                    now.append((doc_id, start, part[: n * width], tokens))
                if n * width < len(part):
                    rest.append((doc_id, start + n, part[n * width :], tokens))
                room -= n
            emit(rows, now)
            held, filled = rest, filled - size
        if rows:
            yield batch(rows, like)

    return run


def pack(docs: DataFrame, ws: Workspace, *, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    # Written, since sampling for the ranges and the sort both read it.
    rows = ws.write(token_rows(docs, path), "tokens")
    ranges = range_count(rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0, *RANGE_BYTES)
    order = ["place", "tie", "doc_id", F.crc32("ids")]
    curve = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(curve, _pieces(id_kind(path), length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
