"""Scores of texts under a hierarchical Pitman-Yor language model of words.

Tokens are the words of a text (A-Z in lower case) and one END. The model is a tree of Chinese
restaurants: a token is a customer of the restaurant of the whole word before it (END before a
text's first), so there are as many restaurants as distinct words; a table there is a customer of
the root, their parent. The root's base gives each new table a word not seen before, so the root has
one table a word, and the mass that it leaves for a further one is the probability of an unknown
word. Known words and the unknown word add up to one. Words go by 64-bit hashes.

Pairs (context, word) are dealt by a hash of both to parts of about PART_BYTES of text, so neither a hot
context nor a hot word gathers in one part. A part is a row of packed arrays (``pack``); so is all
that parts and words' totals exchange.

1. ``count_cells`` counts the pairs of FLUSH tokens at a time; ``_merge`` adds up a part's cells.
2. ``sweep`` is a sweep of Gibbs sampling. The number of tables of a word in a restaurant is drawn from
   its exact conditional given all other words' and restaurants' tables, S(c, t) times the tables'
   weights, where S are the generalised Stirling numbers, so all customers of a pair are seated anew in
   each sweep, however many they are. Up to LADDER customers S comes from its recurrence, beyond from an
   integral over its generating function (``log_sibuya``). A pair seen once has one table. Totals of words
   (tables in their restaurant, customers at the root) go by a hash of the word to be added up and come
   back to the parts that ask; a sweep uses those of the sweep before.
   Concentrations are drawn from their posterior on a grid of powers of two after each sweep.
   Random numbers depend on the pair and the sweep alone, so neither batches nor parts change a result.
3. ``score`` cuts the texts into cells again, this time with the documents of each pair, and sends them
   to the parts. The predictive probabilities of SAMPLES sweeps after BURN are averaged, pair by pair,
   and a part sends back each document's sum.

Memory is that of a part and a flush. Nothing is broadcast; the driver sees a few numbers a part.

Null and empty texts are one END; a null doc_id counts as training with the id "". Repeated rows
count and are scored one by one.
"""

from __future__ import annotations

import functools
import itertools
import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch_words, map_arrow, mix64, text_string

END = b"\n"  # no word holds white space
BURN, SAMPLES = 3, 3
LADDER = 256
PART_BYTES, LEAST_PARTS = 32 << 20, 12
FLUSH = 2_000_000
#: Pairs whose probabilities are worked out at a time.
BLOCK = 1 << 18
#: Numbers of tables that are weighed at a time, and points at which S is worked out for a run of them.
WINDOW, NODES = 1 << 17, 24
#: Concentrations that are tried: of the contexts, and of the root.
THETAS, ROOT_THETAS = 2.0 ** np.arange(-10, 13), 2.0 ** np.arange(-10, 25)

_ROW = "dest long, kind int, frm long, blob binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


# Packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or floats as bytes: the narrowest type each, byte planes, zstd."""
    head, planes = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind == "f":
            a = a.astype("<f8")
        else:
            a = a.astype(np.uint64) if a.dtype != np.uint64 else a
            most = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
        head.append(struct.pack("<cBq", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        planes.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    """What ``pack`` was given, integers as int64."""
    out = []
    kinds = [struct.unpack_from("<cBq", blob, 1 + 10 * k) for k in range(blob[0])]
    data = zstandard.ZstdDecompressor().decompress(blob[1 + 10 * len(kinds) :])
    at = 0
    for kind, width, n in kinds:
        a = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(f"<{kind.decode()}{width}").reshape(n)
        out.append(a if kind == b"f" else a.astype(np.int64))
        at += n * width
    return out


def deltas(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=np.zeros(1, h.dtype))


def sums(d: np.ndarray) -> np.ndarray:
    """The sorted hashes whose ``deltas`` are d."""
    return np.cumsum(d.astype(np.uint64), dtype=np.uint64)


def _rows(batches):
    """Row by row, so that a batch's blobs aren't all held twice."""
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in b.columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    dest, kind, frm, blob = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(kind, pa.int32()), pa.array(frm, pa.int64()), pa.array(blob, pa.binary())], _NAMES)


def _to_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in the task of their dest, by kind."""
    return rows.repartitionById(parts, F.col("dest").cast("int")).sortWithinPartitions("dest", "kind", "frm")


def _each(f):
    """A function of batches from ``f(dest, rows)``, which yields rows."""

    def run(batches):
        for dest, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            yield _batch(list(f(dest, rows)))

    return run


# Tokens and pairs


def batch_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a string column: each one's place in the list of words, its context's place, the texts' offsets, and the words' hashes, END last."""
    place, ends, words = batch_words(pc.ascii_lower(texts))
    words = [*words.cast(pa.large_binary()).to_pylist(), END]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(ends) - 1
    offsets = ends + np.arange(n + 1)
    token = np.empty(offsets[-1], np.int64)
    is_end = np.zeros(len(token), bool)
    is_end[offsets[1:] - 1] = True
    token[is_end], token[~is_end] = len(words) - 1, place
    context = np.empty(len(token), np.int64)
    context[1:] = token[:-1]
    context[offsets[:-1]] = len(words) - 1
    return token, context, offsets, h


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(u, 1) + w, 2)


def uniform(pair: np.ndarray, sweep: int, draw: int = 0) -> np.ndarray:
    """A number in [0, 1) for each pair, sweep and draw."""
    with np.errstate(over="ignore"):
        return (mix64(pair + np.uint64(draw * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF), 1000 + sweep) >> np.uint64(11)) * 2.0**-53


def split(docs: DataFrame) -> DataFrame:
    """body, held_out, doc_id."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(text_string().alias("body"), (crc % 7 == 2).alias("held_out"), "doc_id")


def _pieces(batches, size: int):
    """Slices of the batches whose texts have at most ``size`` bytes, one added for each END, or that are one text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def flushes(batches, size: int = FLUSH):
    """Lists of ``batch_tokens`` and the other columns, of ``size`` tokens to 3/2 of that, or of one text; the last may be shorter."""
    held, n = [], 0
    for b in _pieces(batches, size):
        token, context, offsets, h = batch_tokens(b.column(0))
        if held and n + len(token) > size + size // 2:
            yield held
            held, n = [], 0
        # Taken, not sliced: a slice would hold on to the texts.
        rest = [pc.take(c, pa.array(np.arange(b.num_rows))) for c in b.columns[1:]]
        held.append((token.astype(np.int32), context.astype(np.int32), np.diff(offsets), h, rest))
        n += len(token)
        del b, token, context, offsets, h, rest
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Of a flush, which is emptied: the words' sorted hashes, each token's pair (context * words + token), tokens a text, and the other columns."""
    words = np.unique(np.concatenate([h for *_, h, _ in held]))
    pair, at = np.empty(sum(len(x[0]) for x in held), np.int64), 0
    lengths, rest = [], []
    for k in range(len(held)):
        token, context, length, h, columns = held[k]
        held[k] = None
        place = np.searchsorted(words, h)
        own = pair[at : at + len(token)]
        own[:] = place[context]
        own *= len(words)
        own += place[token]
        at += len(token)
        lengths.append(length)
        rest.append(columns)
    held.clear()
    return words, pair, np.concatenate(lengths), rest


def _by_part(words: np.ndarray, u: np.ndarray, w: np.ndarray, parts: int, times: np.ndarray | None = None):
    """(part, places of its pairs in their order) of each part that has pairs; of each pair ``times`` places, if given."""
    part = (pair_hash(words[u], words[w]) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    if times is not None:
        part = np.repeat(part, times)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype), sorter=order)
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield p, order[bounds[p] : bounds[p + 1]]


def _own_words(words: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words in use, and u, w as places among them."""
    used = np.zeros(len(words), bool)
    used[u] = used[w] = True
    place = np.cumsum(used) - 1
    return words[used], place[u], place[w]


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def count_cells(parts: int, size: int = FLUSH):
    """Rows (part, 0, -, pairs with their training counts)."""

    def cells(held):
        words, key, lengths, rest = _joined(held)
        key *= 2
        key += np.repeat(np.concatenate([out.to_numpy(zero_copy_only=False) for out, *_ in rest]) == 0, lengths)
        key.sort()
        train = (key & 1).astype(np.int8)
        key >>= 1
        at = _starts(key)
        c = np.add.reduceat(train, at, dtype=np.int64)
        u, w = np.divmod(key[at], len(words))
        del key, train, at
        rows = []
        for p, mine in _by_part(words, u, w, parts):
            h, a, b = _own_words(words, u[mine], w[mine])
            rows.append((p, 0, 0, pack(deltas(h), deltas(a), b, c[mine])))
        return _batch(rows)

    return lambda batches: map(cells, flushes(batches, size))


def post_cells(parts: int, size: int = FLUSH):
    """Rows (part, 3, flush, pairs with their documents) and (part, 4, flush, the documents themselves, with ids)."""

    def cells(k, held):
        flush = TaskContext.get().partitionId() << 24 | k
        words, key, lengths, rest = _joined(held)
        # Words and texts together are no more than tokens and one, so three factors fit: a flush has 3 million tokens, or one text.
        key *= len(lengths)
        key += np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        key.sort()
        at = _starts(key)
        n = np.diff(at, append=len(key)).astype(np.int32)
        key = key[at]
        del at
        doc = (key % len(lengths)).astype(np.int32)
        key //= len(lengths)
        first = _starts(key)  # of each pair's documents
        u, w = np.divmod(key[first], len(words))
        del key
        held_by = np.diff(first, append=len(doc))
        pair = np.repeat(np.arange(len(u), dtype=np.int32), held_by)
        rows = []
        for p, mine in _by_part(words, u, w, parts, held_by):
            begins = _starts(pair[mine])
            own = pair[mine[begins]]
            h, x, y = _own_words(words, u[own], w[own])
            step = np.diff(doc[mine], prepend=0)
            step[begins] = doc[mine[begins]]
            rows.append((p, 3, flush, pack(deltas(h), deltas(x), y, held_by[own], step, n[mine])))
        out = _batch([*rows, (flush % parts, 4, flush, pack(np.concatenate([x[0].to_numpy(zero_copy_only=False) for x in rest]).astype(np.int64), lengths))])
        ids = pa.concat_arrays([x[1] for x in rest])
        lists = pa.ListArray.from_arrays(pa.array([0] * (len(rows) + 1) + [len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([*out.columns, lists], [*_NAMES, "ids"])

    return lambda batches: itertools.starmap(cells, enumerate(flushes(batches, size)))


def _merge(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a part's words, and its pairs (u, w, c) in order of u and w. Cells are unpacked as they come and kept as narrow as they go."""
    found = []
    for x in cells:
        h, u, w, c = unpack(x)
        found.append((sums(h), np.cumsum(u).astype(np.min_scalar_type(len(h))), w.astype(np.min_scalar_type(len(h))), c.astype(np.min_scalar_type(c.max()))))
        del h, u, w, c
    words = np.unique(np.concatenate([h for h, *_ in found]))
    key, a = np.empty(sum(len(c) for *_, c in found), np.int64), 0
    counts = np.empty(len(key), np.result_type(*(c.dtype for *_, c in found)))
    for k in range(len(found)):
        h, u, w, c = found[k]
        found[k] = None
        at = np.searchsorted(words, h)
        own = key[a : a + len(c)]
        own[:] = at[u]
        own *= len(words)
        own += at[w]
        counts[a : a + len(c)] = c
        a += len(c)
        del h, u, w, c, at, own
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    del order
    at = _starts(key)
    return words, *np.divmod(key[at], len(words)), np.add.reduceat(counts, at, dtype=np.int64)


def _shard(blob: bytes):
    h, u, w, c = unpack(blob)
    return sums(h), np.cumsum(u), w, c


def _by_word(h: np.ndarray, bits: int):
    """(q, slice) of the sorted hashes that belong to each part of the words' totals."""
    bounds = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for q in range(1 << bits):
        if bounds[q] < bounds[q + 1]:
            yield q, slice(bounds[q], bounds[q + 1])


def _add(at: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)


# Likelihoods


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    below = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def restaurant_log(theta: np.ndarray, d: float, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """For each theta, the sum over restaurants of the logarithm of what depends on it: (theta | d)_tables / (theta)_customers."""
    if not len(tables):
        return np.zeros(len(theta))
    (t, n), times = np.unique(np.stack([tables, customers]), axis=1, return_counts=True)
    return np.array([float(times @ ((t - 1) * math.log(d) + _lgamma(x / d + t) - _lgamma(np.array(x / d + 1.0)) - _lgamma(x + n) + _lgamma(np.array(x + 1.0)))) for x in theta])


def _drawn(grid: np.ndarray, log: np.ndarray, number: int) -> float:
    p = np.cumsum(np.exp(log - log.max()))
    return float(grid[np.searchsorted(p, uniform(np.array([number], np.uint64), number)[0] * p[-1], "right")])


# Seatings


def stirling(d: float, most: int = LADDER) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - d * t, 0)) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, 0 : c + 1], stay)
    return out


@dataclass(frozen=True)
class Rates:
    """Discounts and concentrations of contexts and root, and the root's customers."""

    d: float
    theta: float
    root_d: float
    root_theta: float
    customers: int

    def table(self, tables, root) -> np.ndarray:
        """What a further table weighs beside that many tables in the restaurant and customers of its word at the root."""
        return (self.theta + self.d * tables) * np.maximum(root - self.root_d, 1e-12)


def draw(c: np.ndarray, tables: np.ndarray, root: np.ndarray, others: np.ndarray, logs: np.ndarray, rates: Rates, x: np.ndarray) -> np.ndarray:
    """The tables of c customers (LADDER at most) from their exact conditional.

    tables, root, others: those of the restaurant, of the word at the root, and all customers of the root, without this pair's own.
    """
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    for at in np.split(order, _starts(c[order])[1:]):
        if not len(at):
            continue
        v = int(c[at[0]])
        k = np.arange(v)
        for i in range(0, len(at), step := max(1, 1_000_000 // v)):
            a = at[i : i + step]
            log = np.log(rates.table(tables[a, None] + k, root[a, None] + k) / (rates.root_theta + others[a, None] + k))
            log = np.cumsum(log, axis=1) + logs[v, 1 : v + 1]
            p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[a] = 1 + np.minimum((p <= x[a, None] * p[:, -1:]).sum(axis=1), v - 1)
    return out


@functools.cache
def _saddles(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(tables / customers) and log(mu), rising, where exp(-mu) is the saddle point of ``log_sibuya``."""
    m = np.linspace(-60, 3.2, 8000)
    mu = np.exp(m)
    y = np.log1p(-np.exp(-np.maximum(mu, 0.5)))
    y = np.where(mu < 0.5, np.log(-np.expm1(-mu)), y)
    return np.log(-np.expm1(d * y)) - math.log(d) + mu + (1 - d) * y, m


def _log_g(d: float, z: np.ndarray) -> np.ndarray:
    """log(1 - (1 - exp(z))^d); the series is for exp(z) below 0.05."""
    if z.size and z.real.max() < -3:
        x, total = np.exp(z), 0.0
        for j in range(14, 0, -1):
            total = (total + 1) * x * ((j - d) / (j + 1))
        return math.log(d) + z + np.log1p(total)
    return np.log1p(-((-np.expm1(z)) ** d))


def log_sibuya(d: float, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The logarithm of the coefficient of x^n in g^k, g = 1 - (1 - x)^d: the generalised Stirling number S(n, k) times d^k k! / n!. k may be a fraction.

    Cauchy's integral over z = log x from the saddle point -mu on: along a parabola around the branch cut where mu is small, else straight up.
    """
    shape = np.broadcast_shapes(np.shape(n), np.shape(k))
    n, k = (np.broadcast_to(v, shape).astype(float).ravel() for v in (n, k))
    mu = np.minimum(np.maximum(np.exp(np.interp(np.log(k / n), *_saddles(d))), 2 / n), 1 + np.log(n))
    y = -np.expm1(-mu)
    log_g = np.empty(len(n))
    bent, straight, far = (np.flatnonzero(x) for x in (mu <= 0.25, (mu > 0.25) & (mu <= 3), mu > 3))
    for at in (bent, straight, far):
        log_g[at] = _log_g(d, -mu[at])
    slope = d * np.exp(-mu - log_g) * y ** (d - 1)
    width = 1 / np.sqrt(np.maximum(k * slope * (1 + (1 - d) * np.exp(-mu) / y - slope), 1e-300))
    top = n * mu + k * log_g
    out = np.empty(len(n))

    def integral(at, z, dz):
        log = _log_g(d, z) * k[at, None]
        small = k[at] * y[at] ** d < 1  # there the 1 that g^k is near, whose integral is 0, is left out
        total = np.where(small[:, None], np.expm1(np.where(small[:, None], log, 0)) * np.exp(-n[at, None] * (z + mu[at, None])), np.exp(log - n[at, None] * z - top[at, None]))
        out[at] = np.log((total * dz).real.sum(axis=1)) + np.where(small, n[at] * mu[at], top[at])

    step = 4000
    a = np.minimum(1, width / (2 * mu))
    narrow = a[bent] < 0.1
    for some, points, h in ((bent[narrow], 16, 0.18), (bent[~narrow], 24, 0.15)):
        v = (np.arange(points) + 0.5) * h
        for i in range(0, len(some), step):
            at = some[i : i + step]
            turn = 1 + 1j * a[at, None] * np.sinh(v)
            integral(at, -mu[at, None] * turn**2, turn * (a * mu)[at, None] * np.cosh(v) * (h * 2 / math.pi))
    narrow = width[straight] < 0.1
    for some, points in ((straight[narrow], 24), (straight[~narrow], 80), (far, 80)):
        for i in range(0, len(some), step):
            at = some[i : i + step]
            h = np.minimum(math.pi / 80, 0.35 * width[at])[:, None]
            integral(at, -mu[at, None] + 1j * h * (np.arange(points) + 0.5), h / math.pi)
    return out.reshape(shape)


def _likely(c, tables, root, others, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the numbers of tables outside which the conditional of ``draw`` is below exp(-36) or so of its greatest value, by a rougher S."""
    n, places = c[:, None].astype(float), np.linspace(0, 1, 24)
    lo, hi = np.ones(len(c)), c.astype(float)
    each = np.arange(len(c))
    for _ in range(5):
        k = lo[:, None] * (hi / lo)[:, None] ** places
        mu = np.maximum(np.exp(np.interp(np.log(k / n), *_saddles(rates.d))), 1 / n)
        power = np.exp(rates.d * np.log(-np.expm1(-mu)))
        log = k * np.log1p(-power) + n * mu + np.log(np.minimum(1, k * power)) + _weight(k, tables[:, None], root[:, None], others[:, None], rates)
        near = log > log.max(axis=1, keepdims=True) - 45
        a, b = np.maximum(near.argmax(axis=1) - 1, 0), np.minimum(len(places) - near[:, ::-1].argmax(axis=1), len(places) - 1)
        lo, hi = k[each, a], k[each, b]
    return np.maximum(np.floor(lo), 1).astype(np.int64), np.minimum(np.ceil(hi), c).astype(np.int64)


def _weight(k, tables, root, others, rates: Rates) -> np.ndarray:
    """The logarithm of the weights of k tables over d^k k!, up to what doesn't depend on k."""
    return _lgamma(rates.theta / rates.d + tables + k) + _lgamma(root + k - rates.root_d) - _lgamma(rates.root_theta + others + k) - _lgamma(k + 1.0)


def _conditional(c, tables, root, others, rates: Rates, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pair's run of numbers of tables from lo to hi begins, all their weights, the greatest of a run 1, and its logarithm over that of lo's ``_weight``."""
    length = hi - lo + 1
    begin = np.cumsum(length) - length
    i = np.repeat(np.arange(len(c)), length)
    k = np.arange(len(i)) - begin[i] + lo[i]
    # S is worked out number by number in short runs and those that end at c, else at a few points of log k, between which it is a polynomial.
    alone = (length <= NODES) | (c - hi < 20)
    log, each = np.empty(len(k)), alone[i]
    log[each] = log_sibuya(rates.d, c[i[each]], k[each])
    if not alone.all():
        r, of = np.flatnonzero(~alone), (np.cumsum(~alone) - 1)[i[~each]]
        angle = (np.arange(NODES) + 0.5) * math.pi / NODES
        low, span = np.log(lo[r]), np.log(hi[r] / lo[r])
        points = np.exp(low[:, None] + span[:, None] * (np.cos(angle) + 1) / 2)
        close = (c - hi < length)[r]  # to c, beyond which (c - k)! has poles
        found = log_sibuya(rates.d, c[r, None], points)
        found[close] += _lgamma(c[r[close], None] - points[close] + 1)
        series = found @ np.cos(np.outer(angle, np.arange(NODES))) * (2 / NODES)
        x = 2 * (np.log(k[~each]) - low[of]) / span[of] - 1
        b1 = b2 = np.zeros(len(x))
        for j in range(NODES - 1, 0, -1):
            b1, b2 = 2 * x * b1 - b2 + series[of, j], b1
        found = x * b1 - b2 + series[of, 0] / 2
        found[close[of]] -= _lgamma((c[i] - k)[~each][close[of]] + 1.0)
        log[~each] = found
    before = k - 1
    rise = np.log(rates.table(tables[i] + before, root[i] + before) / ((rates.root_theta + others[i] + before) * (rates.d * k)))
    rise[begin] = 0
    rise = np.cumsum(rise)
    log += rise - rise[begin][i]
    top = np.maximum.reduceat(log, begin)
    return begin, np.exp(log - top[i]), top


def draw_many(c: np.ndarray, tables: np.ndarray, root: np.ndarray, others: np.ndarray, rates: Rates, x: np.ndarray) -> np.ndarray:
    """As ``draw``, for any number of customers."""
    lo, hi = _likely(c, tables, root, others, rates)
    x = x.copy()
    for a in np.flatnonzero(hi - lo >= WINDOW):  # one of many runs is drawn first
        at = np.array([a])
        given = c[at], tables[at], root[at], others[at]
        begins = np.arange(lo[a], hi[a] + 1, WINDOW)
        ends = np.minimum(begins + WINDOW - 1, hi[a])
        log = np.empty(len(begins))
        for j in range(len(begins)):
            _, p, top = _conditional(*given, rates, begins[j : j + 1], ends[j : j + 1])
            log[j] = math.log(p.sum()) + top[0] + _weight(begins[j : j + 1], *given[1:], rates)[0]
        p = np.exp(log - log.max())
        p /= p.sum()
        j = min(int(np.searchsorted(np.cumsum(p), x[a], "right")), len(p) - 1)
        lo[a], hi[a], x[a] = begins[j], ends[j], min(max((x[a] - p[:j].sum()) / p[j], 0.0), 1 - 2.0**-53)
    out = np.empty(len(c), np.int64)
    group = np.cumsum(hi - lo + 1) // WINDOW
    for at in np.split(np.arange(len(c)), _starts(group)[1:]):
        if not len(at):
            continue
        begin, p, _ = _conditional(c[at], tables[at], root[at], others[at], rates, lo[at], hi[at])
        p /= np.repeat(np.add.reduceat(p, begin), hi[at] - lo[at] + 1)
        place = np.searchsorted(np.cumsum(p), np.arange(len(at)) + x[at], "right")
        out[at] = np.clip(place - begin + lo[at], lo[at], hi[at])
    return out


# Seating one customer after another, which ``draw_many`` must agree with; its work grows with the customers, so no sweep does it.


def opened(c: np.ndarray, mass: np.ndarray, d: float) -> list[np.ndarray]:
    """Sizes of tables to begin with: about as many as seating in sequence opens, the first the largest."""
    out = []
    for n, a in zip(c.tolist(), mass.tolist(), strict=True):
        t, i = 1.0, 1
        while i < n:
            g = min(max(1, i // 32), n - i)
            t += g * a / (a + i + (g - 1) / 2 - d * t)
            i += g
        share = np.arange(1, min(n, max(1, round(t))) + 1) ** (-1 / d)
        size = np.maximum(1, np.floor(n * share / share.sum())).astype(np.int64)
        size[0] += n - size.sum()
        out.append(size if size[0] > 0 else np.array([n]))
    return out


def move(c: np.ndarray, sizes: list[np.ndarray], tables: np.ndarray, root: np.ndarray, others: np.ndarray, rates: Rates, pair: np.ndarray, sweep: int, moves: int) -> list[np.ndarray]:
    """``moves`` customers of each pair leave their table, a customer picked at random each time, and are seated anew."""
    t = np.array([len(s) for s in sizes], np.int64)
    begin = np.cumsum(t + moves) - t - moves  # with room for new tables
    size = np.zeros(int((t + moves).sum()), np.int64)
    size[np.concatenate([np.arange(b, b + n) for b, n in zip(begin, t, strict=True)])] = np.concatenate(sizes)
    free = begin + t
    for k in range(moves):
        total = np.cumsum(size)
        j = np.searchsorted(total, total[begin] - size[begin] + np.floor(uniform(pair, sweep, 2 * k + 1) * c).astype(np.int64), "right")
        size[j] -= 1
        t -= size[j] == 0
        new = rates.table(tables + t, root + t) / (rates.root_theta + others + t)
        old = c - 1 - rates.d * t
        x = uniform(pair, sweep, 2 * k + 2) * (old + new)
        weight = np.where(size > 0, size - rates.d, 0.0)
        total = np.cumsum(weight)
        j = np.clip(np.searchsorted(total, total[begin] - weight[begin] + x, "right"), begin, free - 1)
        j = np.where((x >= old) | (size[j] == 0), free, j)
        t += j == free
        free += j == free
        size[j] += 1
    return [s[s > 0] for s in np.split(size, begin[1:])] if len(c) else []


# Jobs. Rows of a part: its state (kind 0), the words' totals (1), and what goes to the driver (2).


def _first(bits: int):
    """From a part's cells: the part (0), its words' counts for the words' totals (1), its tokens and pairs seen once and twice (2)."""

    def f(p, rows):
        words, u, w, c = _merge(blob for *_, blob in rows)
        n = len(words)
        yield p, 0, p, pack(deltas(words), deltas(u), w, c)
        once, many = c == 1, c > 1
        active = np.zeros(n, bool)
        active[u[many]] = active[w[many]] = True
        counts = _add(w, n, c), _add(u[once], n), _add(w[once], n), _add(w[c > 0], n), active
        for q, at in _by_word(words, bits):
            yield q, 1, p, pack(deltas(words[at]), *(x[at] for x in counts))
        yield p, 2, p, pack(np.array([c.sum(), once.sum(), (c == 2).sum()]))

    return _each(f)


def _added(rows) -> tuple[np.ndarray, list[tuple], list[np.ndarray]]:
    """From messages (hashes, values ...): the words, (sender, places of its words, values), and the values' totals."""
    found = [(p, unpack(blob)) for _, _, p, blob in rows]
    words = np.unique(np.concatenate([sums(x[0]) for _, x in found]))
    totals = [np.zeros(len(words), np.int64) for _ in found[0][1][1:]]
    sent = []
    for p, (h, *values) in found:
        at = np.searchsorted(words, sums(h))
        for total, v in zip(totals, values, strict=True):
            total[at] += v
        sent.append((p, at, values))
    return words, sent, totals


def _known(d: float):
    """From the first counts: (customers, tables and root customers of pairs seen once) of the words that the parts ask for (1), and statistics (2)."""

    def f(q, rows):
        _, sent, (n, tables, root, contexts, _) = _added(rows)
        for p, at, values in sent:
            asked = at[values[4].astype(bool)]
            yield p, 1, q, pack(n[asked], tables[asked], root[asked])
        full = (n > 0) & (tables == n)  # each of its pairs is seen once, so nothing changes
        counts = [(n > 0).sum(), (contexts == 1).sum(), (contexts == 2).sum(), root.sum()]
        yield q, 2, q, pack(np.concatenate((np.array(counts, float), restaurant_log(THETAS, d, tables[full], n[full]))))

    return _each(f)


def _gather(rows: list[bytes]) -> list[np.ndarray]:
    """The words' totals in the order of the part's words: answers come by q, and q follows the hashes."""
    found = [unpack(x) for x in rows]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


@dataclass
class _State:
    """The pairs of a part that are seen more than once, and their words."""

    words: np.ndarray
    n: np.ndarray
    tables: np.ndarray
    root: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    t: np.ndarray
    samples: list[np.ndarray] = field(default_factory=list)

    def packed(self) -> bytes:
        return pack(deltas(self.words), self.n, self.tables, self.root, deltas(self.u), self.w, self.c, self.t, *self.samples)

    @classmethod
    def of(cls, blob: bytes) -> _State:
        words, n, tables, root, u, w, c, t, *samples = unpack(blob)
        return cls(sums(words), n, tables, root, np.cumsum(u), w, c, t, samples)

    def rows(self, p: int, bits: int, log: np.ndarray):
        yield p, 0, p, self.packed()
        k = len(self.words)
        tables, root = _add(self.u, k, self.t), _add(self.w, k, self.t)
        for q, at in _by_word(self.words, bits):
            yield q, 1, p, pack(deltas(self.words[at]), self.n[at], self.tables[at], tables[at], root[at])
        yield p, 2, p, pack(np.concatenate(([float(self.t.sum())], log)))


def _start(bits: int):
    """From parts (0) and totals (1): states of one table a pair."""

    def f(p, rows):
        words, u, w, c = _shard(next(rows)[3])
        n, tables, root = _gather([x[3] for x in rows])
        many = c > 1
        active = np.zeros(len(words), bool)
        active[u[many]] = active[w[many]] = True
        place = np.cumsum(active) - 1
        c = c[many]
        state = _State(words[active], n, tables, root, place[u[many]], place[w[many]], c, np.ones(len(c), np.int64))
        yield from state.rows(p, bits, np.zeros(len(THETAS)))

    return _each(f)


def _answers(d: float, parts: int):
    """From messages: the totals of the words (1) and the likelihoods of the concentrations (2), both to the parts."""

    def f(q, rows):
        words, sent, (_, _, tables, root) = _added(rows)
        n, still = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for p, at, values in sent:
            n[at], still[at] = values[0], values[1]
            yield p, 1, q, pack(tables[at], root[at])
        changes = n > still
        yield q % parts, 2, q, pack(restaurant_log(THETAS, d, (still + tables)[changes], n[changes]))

    return _each(f)


def _swept(rates: Rates, number: int, keep: bool, bits: int):
    """From states (0), totals (1) and likelihoods (2): states after a sweep, with the seatings as a sample if ``keep``."""
    logs = stirling(rates.d)

    def f(p, rows):
        found: dict[int, list] = {0: [], 1: [], 2: []}
        for _, kind, _, blob in rows:
            found[kind].append(blob)
        log = sum((unpack(x)[0] for x in found[2]), np.zeros(len(THETAS)))
        if not found[0]:
            if found[2]:
                yield p, 2, p, pack(np.concatenate(([0.0], log)))
            return
        s = _State.of(found[0][0])
        if len(s.c):
            tables, root = _gather(found[1])
            tables, root = (s.tables + tables)[s.u] - s.t, (s.root + root)[s.w] - s.t
            others = rates.customers - s.t
            pair = pair_hash(s.words[s.u], s.words[s.w])
            x = uniform(pair, number)
            t = np.empty_like(s.t)
            few = s.c <= LADDER
            t[few] = draw(s.c[few], tables[few], root[few], others[few], logs, rates, x[few])
            t[~few] = draw_many(s.c[~few], tables[~few], root[~few], others[~few], rates, x[~few])
            s.t = t
        if keep:
            s.samples.append(s.t)
        yield from s.rows(p, bits, log)

    return _each(f)


def _asked(bits: int):
    """From parts (0) and states (1): the counts of all words in each sample, for the words' totals."""

    def f(p, rows):
        words, u, w, c = _shard(next(rows)[3])
        s = _State.of(next(rows)[3])
        n = len(words)
        counts = [_add(w, n, c), *(_add(u, n, _seating(c, t)) for t in s.samples), *(_add(w, n, _seating(c, t)) for t in s.samples)]
        for q, at in _by_word(words, bits):
            yield q, 1, p, pack(deltas(words[at]), *(x[at] for x in counts))

    return _each(f)


def _seating(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The tables of all pairs, from those of the pairs seen more than once."""
    out = np.minimum(c, 1)
    out[c > 1] = t
    return out


def _seatings(c: np.ndarray, s: _State) -> list[np.ndarray]:
    """The tables of all pairs of a part in each sample."""
    return [_seating(c, t) for t in s.samples]


def _totals(q, rows):
    _, sent, totals = _added(rows)
    for p, at, _ in sent:
        yield p, 2, q, pack(*(x[at] for x in totals))


# The model


@dataclass
class Model:
    parts: int
    bits: int
    train_tokens: int
    words: int
    shards: DataFrame
    state: DataFrame
    totals: DataFrame
    rates: list[Rates]
    tables: list[int]  # of pairs seen more than once, after each sweep

    def probabilities(self, u_n, u_tables, w_n, w_root, c, t) -> np.ndarray:
        """The predictive probability of a word in a context, averaged over the samples; tables and customers at the root by sample."""
        out = 0.0
        for r, tables, root, seated in zip(self.rates, u_tables, w_root, t, strict=True):
            base = np.where(w_n > 0, root - r.root_d, r.root_theta + r.root_d * self.words) / (r.root_theta + r.customers)
            out = out + (np.maximum(c - r.d * seated, 0) + (r.theta + r.d * tables) * base) / (r.theta + u_n)
        return out / len(self.rates)

    def part(self, shard: bytes, state: bytes, totals: list[bytes]):
        """words' hashes, pairs' keys, their log10 probabilities, and the words' log10 base probabilities and whether they are known."""
        words, u, w, c = _shard(shard)
        n, *more = _gather(totals)
        k = len(self.rates)
        samples = _State.of(state).samples
        logs, seen = np.empty(len(c)), 0  # seen: pairs before the block with a seating of their own
        for a in range(0, len(c), BLOCK):
            x, y, z = (v[a : a + BLOCK] for v in (u, w, c))
            own = slice(seen, seen := seen + int((z > 1).sum()))
            p = self.probabilities(n[x], [v[x] for v in more[:k]], n[y], [v[y] for v in more[k:]], z, [_seating(z, t[own]) for t in samples])
            logs[a : a + BLOCK] = np.log10(p)
        u *= len(words)
        u += w
        return words, u, logs, np.log10((n + 1) / (self.train_tokens + self.words + 1)), n > 0


def _discount(ones: float, twos: float) -> float:
    """Kneser and Ney's estimate n1 / (n1 + 2 n2), with one table a word below."""
    return min(0.98, max(0.02, ones / (ones + 2 * twos) if ones + twos else 0.5))


def fit(texts: DataFrame, ws: Workspace, *, burn: int = BURN, samples: int = SAMPLES, parts: int | None = None, flush: int = FLUSH) -> Model:
    """The model of the rows of ``split`` that aren't held out."""
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = parts or max(LEAST_PARTS, -(-size // PART_BYTES))
    bits = max(1, (parts - 1).bit_length())

    def job(rows: DataFrame, to: int, f, name: str):
        """The rows that ``f`` makes of rows at their dest, by kind."""
        done = ws.write(_to_parts(rows, to).mapInArrow(f, _ROW), name, by="kind", free=True)
        return lambda kind: done.where(F.col("kind") == kind).select(*_NAMES)

    def numbers(rows: DataFrame) -> np.ndarray:
        """The sum of what the parts say."""
        return sum((unpack(bytes(r.blob))[0].astype(float) for r in rows.select("frm", "blob").orderBy("frm").collect()), np.zeros(1))

    cells = map_arrow(texts.select("body", "held_out"), count_cells(parts, flush), _ROW)
    first = job(cells, parts, _first(bits), "first")
    shards = first(0)
    tokens, ones, twos = (numbers(first(2)) + np.zeros(3)).tolist()
    d = _discount(ones, twos)
    known = job(first(1), 1 << bits, _known(d), "known")
    words, lone, pairs, once, *still = (numbers(known(2)) + np.zeros(4 + len(THETAS))).tolist()
    root_d, still = _discount(lone, pairs), np.array(still)
    state = job(shards.union(known(1)), parts, _start(bits), "state-0")
    ws.drop("known", "first/kind=1")
    theta = root_theta = 1.0
    kept, tables = [], []
    seated = numbers(state(2))[0]
    to_root = lambda: int(once + seated)
    for k in range(1, burn + samples + 1):
        rates = Rates(d, theta, root_d, root_theta, to_root())
        answers = _to_parts(state(1), 1 << bits).mapInArrow(_answers(d, parts), _ROW)
        state = job(state(0).union(answers), parts, _swept(rates, k, k > burn, bits), f"state-{k}")
        ws.drop(f"state-{k - 1}")
        seated, *log = (numbers(state(2)) + np.zeros(1 + len(THETAS))).tolist()
        tables.append(int(seated))
        if k > burn:
            kept.append(Rates(d, theta, root_d, root_theta, to_root()))
        theta = _drawn(THETAS, still + np.array(log), 2 * k)
        root_theta = _drawn(ROOT_THETAS, restaurant_log(ROOT_THETAS, root_d, np.array([max(words, 1)]), np.array([max(to_root(), 1)])), 2 * k + 1)
    asked = _to_parts(shards.union(state(0).withColumn("kind", F.lit(1))), parts).mapInArrow(_asked(bits), _ROW)
    totals = ws.write(_to_parts(asked, 1 << bits).mapInArrow(_each(_totals), _ROW), "totals", free=True)
    return Model(parts, bits, int(tokens), int(words), shards, state(0).withColumn("kind", F.lit(1)), totals, kept, tables)


def _scored(model: Model, kind: str):
    """From parts (0), states (1), totals (2), cells (3) and documents (4): each flush's documents (0) and the sums of its cells (1), by flush."""
    numbers = Model(model.parts, model.bits, model.train_tokens, model.words, None, None, None, model.rates, [])
    names = [*_NAMES, "ids"]

    def run(batches):
        for _, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            blobs: dict[int, list] = {0: [], 1: [], 2: []}
            part = None
            for _, of, flush, blob, ids in rows:
                if of < 3:
                    blobs[of].append(blob)
                    continue
                if of == 4:
                    out, ids = (flush, 0, flush, blob), ids
                else:
                    part = part or numbers.part(blobs[0].pop(), blobs[1].pop(), blobs[2])
                    words, keys, logs, base, known = part
                    h, u, w, held_by, step, n = unpack(blob)
                    at = np.searchsorted(words, sums(h))
                    pair = np.searchsorted(keys, at[np.cumsum(u)] * len(words) + at[w])
                    word = at[w]
                    # Steps from document to document begin anew with each pair.
                    run_sum = np.cumsum(step)
                    begins = np.cumsum(held_by) - held_by
                    doc = run_sum - np.repeat(run_sum[begins] - step[begins], held_by)
                    pair, word = np.repeat(pair, held_by), np.repeat(word, held_by)
                    docs, place = np.unique(doc, return_inverse=True)
                    add = lambda x, place=place, n=n: np.bincount(place, weights=n * x)
                    out, ids = (flush, 1, flush, pack(deltas(docs), add(known[word]).astype(np.int64), add(base[word]), add(logs[pair]))), None
                b = _batch([out])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([ids], pa.list_(kind))], names)

    return run


def _finished(kind):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for _, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            _, _, _, blob, ids = next(rows)
            held, tokens = unpack(blob)
            known, base, score = np.zeros(len(tokens), np.int64), np.zeros(len(tokens)), np.zeros(len(tokens))
            for *_, blob, _ in rows:
                docs, k, x, y = unpack(blob)
                docs = np.cumsum(docs)
                known[docs] += k
                base[docs] += x
                score[docs] += y
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(held.astype(bool)), *(pa.array(x) for x in (tokens, known, base, score))], names)

    return run


def score(docs: DataFrame, ws: Workspace, *, burn: int = BURN, samples: int = SAMPLES, parts: int | None = None, flush: int = FLUSH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    texts = split(docs)
    model = fit(texts, ws, burn=burn, samples=samples, parts=parts, flush=flush)
    field = docs.schema["doc_id"].dataType
    kind, shape = to_arrow_type(field), f"{_ROW}, ids array<{field.simpleString()}>"
    cells = map_arrow(texts, post_cells(model.parts, flush), shape)
    rows = model.shards.union(model.state).union(model.totals).withColumn("ids", F.lit(None).cast(f"array<{field.simpleString()}>")).unionByName(cells)
    sums_ = _to_parts(rows, model.parts).mapInArrow(_scored(model, kind), shape)
    done = sums_.repartition(model.parts, "dest").sortWithinPartitions("dest", "kind", "frm").mapInArrow(_finished(kind), f"doc_id {field.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # Sums are added in the order of their arrival, which differs by the last bits.
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> float:
    """Of the held-out texts."""
    r = scores.where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return math.pow(10, -r.s / r.n)
