"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct shingles of SHINGLE words (A-Z in lower case); one with fewer
words is a single shingle. Two documents are linked if 100 * |A & B| >= 75 * |A | B|.

1. Documents with equal sets form a class (``classes``); only classes go on, so a third of the
   corpus may be copies of one text.
2. Each class has a signature of TREES * DEPTH MinHash values. The forest is TREES sorted orders
   of the classes: order t sorts by the signature read from value t * DEPTH on, around.
3. Classes that share at least DEPTH leading values in an order form a region. A class's candidates are
   its predecessor in the order, which shares the longest prefix with it, and the first class of
   that prefix, up to DEEP further values deep: as deep as the class has company.
   In a region of up to WIDE classes all meet.
4. Candidates whose sketches (a byte of each MinHash value) agree in ALIKE places or more are
   confirmed on full shingle sets: first each class with the least of its candidates, which in a
   large group is nearly always the same one, then those that this has not joined yet.
5. In regions wider than WIDE not each pair was a candidate. Where such a region holds several components,
   each class outside the largest one is compared with all of the region's classes, in blocks of BLOCK
   by BLOCK: by sketches, and where these are alike by full sets. One link joins two components, so a block that
   has found one leaves their other pairs out; no other pair is left out.

Two sets at similarity 0.75 or more agree in fewer than ALIKE places with a probability below 1e-6.
A pair at similarity 0.75 shares a region in some order with probability 1 - (1 - 0.75**4)**28,
all but 2.4 in 100,000.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows
with equal doc_id and text are one document and share one verdict; a null doc_id is larger than all others.
Ids are integers. Extra columns are carried in a struct and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, Workspace, batch_words, map_arrow, mix64, range_count, text_string

PERCENT = 75
TREES, DEPTH, DEEP = 28, 4, 4
WIDE = 8
ALIKE, BLOCK = 62, 1024
SALTS = 16
#: Rows of a range of the sorted orders, at least and at most.
RANGE_ROWS = 200_000, 20_000_000

_FACTORS = mix64(np.arange(SHINGLE), 3) | np.uint64(1)
_A = mix64(np.arange(TREES * DEPTH), 5) | np.uint64(1)
_B = mix64(np.arange(TREES * DEPTH), 7)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes, sorted, of each text of a string column."""
    place, ends, words = batch_words(pc.ascii_lower(texts))
    words = words.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[place]
    out = []
    with np.errstate(over="ignore"):
        # A word's hash is mixed anew for each of its places in a shingle.
        total = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            total += mix64(h[k : k + len(total)], k) * _FACTORS[k]
        total = mix64(total)
    for k in range(len(ends) - 1):
        at, n = int(ends[k]), int(ends[k + 1] - ends[k])
        if n >= SHINGLE:
            out.append(np.unique(total[at : at + n - SHINGLE + 1]))
        elif n:
            few = b" ".join(words[i] for i in place[at : at + n])
            out.append(np.array([xxhash.xxh3_64_intdigest(few, seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 32 bits; long sets are taken in blocks."""
    least = np.full(len(_A), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            block = hashes[at : at + 2048, None] * _A[None, :]
            block += _B[None, :]
            np.minimum(least, block.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cid (16 bytes that stand for the set; null if it is empty), signature, version (a hash of the text)."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1))
            cid = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
            sig = [signature(h).tobytes() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.binary()), b.column(2)], ["doc_id", "n_shingles", "cid", "signature", "version"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_string(), F.xxhash64("text")), run, "doc_id long, n_shingles long, cid binary, signature binary, version long")


def forest_rows(classes: DataFrame) -> DataFrame:
    """(region, deep, cid, n): each class in each of the TREES orders; region is a hash of the order and its first DEPTH values."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, TREES * DEPTH).astype(np.uint64)
            cid, n = b.column(0), b.column(2)
            for t in range(TREES):
                own = np.roll(sig, -t * DEPTH, axis=1)
                region = np.full(b.num_rows, t, np.uint64)
                for k in range(DEPTH):
                    region = mix64(region ^ own[:, k], k)
                deep = np.zeros(b.num_rows, np.uint64)
                for k in range(DEPTH, DEPTH + DEEP):
                    deep = (deep << np.uint64(16)) | (own[:, k] >> np.uint64(16))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(deep.view(np.int64)), cid, n], ["region", "deep", "cid", "n"])

    return map_arrow(classes.select("cid", "signature", "n"), run, "region long, deep long, cid binary, n long")


_FOUND = "a binary, b binary, region long, member binary, n long"


def _neighbours(batches):
    """From a sorted run: candidate pairs (a, b), and the members of wide regions and of those at the run's ends."""
    region, first = None, True
    before = None
    prefixes: list[int] = []  # of the last row, from none of the further values to all DEEP of them
    heads: list[tuple] = []  # the first class that has each of these
    open_rows: list[tuple] = []  # the region's members while it isn't known to be wide
    wide = False
    shifts = [64 - 64 // DEEP * k for k in range(DEEP + 1)]

    for b in batches:
        pairs_a, pairs_b, regions, members, sizes = [], [], [], [], []

        def member(rows, regions=regions, members=members, sizes=sizes):
            for r, c, n in rows:
                regions.append(r)
                members.append(c)
                sizes.append(n)

        for r, deep, c, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            mine = [(deep & 0xFFFFFFFFFFFFFFFF) >> k for k in shifts]
            if r != region:
                if first and region is not None:
                    member(open_rows)
                    first = False
                region, before, open_rows, wide = r, (c, n), [(r, c, n)], False
                prefixes, heads = mine, [(c, n)] * (DEEP + 1)
                continue
            shared = next((k for k in range(DEEP + 1) if mine[k] != prefixes[k]), DEEP + 1)
            others = {x[0]: x[1] for x in (before, heads[shared - 1])}
            if not wide:
                # Few members: all of them meet.
                others |= {oc: on for _, oc, on in open_rows}
            for oc, on in others.items():
                if 100 * min(on, n) >= PERCENT * max(on, n):
                    pairs_a.append(min(c, oc))
                    pairs_b.append(max(c, oc))
            prefixes, heads, before = mine, heads[:shared] + [(c, n)] * (DEEP + 1 - shared), (c, n)
            if wide:
                member([(r, c, n)])
            else:
                open_rows.append((r, c, n))
                if len(open_rows) > WIDE:
                    wide = True
                    member(open_rows)
                    open_rows = []
        k, m = len(pairs_a), len(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs_a + [None] * m, pa.binary()), pa.array(pairs_b + [None] * m, pa.binary()), pa.array([None] * k + regions, pa.int64()), pa.array([None] * k + members, pa.binary()), pa.array([None] * k + sizes, pa.int64())], ["a", "b", "region", "member", "n"]
        )
    if open_rows:
        r, c, n = zip(*open_rows, strict=True)
        none = [None] * len(r)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(r, pa.int64()), pa.array(c, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "region", "member", "n"])


def components(edges: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): roots are the least nodes.

    Each round hooks every node to its least neighbour, follows that neighbour's hook, and keeps the
    edges between the nodes so reached. Nodes are hashes, so rounds grow with the logarithm of a component.
    """
    edges = ws.write(edges.select("a", "b").where("a <> b").distinct(), f"{label}-e0")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        up = hooks.select(F.col("node").alias("p"), F.col("p").alias("q"))
        maps.append(ws.write(hooks.join(up, "p").select("node", F.col("q").alias("root")), f"{label}-m{len(maps)}"))
        left, right = (maps[-1].select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        met = edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = ws.write(met.where("a <> b").distinct(), f"{label}-e{len(maps)}")
        ws.drop(f"{label}-e{len(maps) - 1}")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0]
    for step in maps[1:]:
        to = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        roots = roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return ws.write(roots, f"{label}-roots")


def _texts_of(docs: DataFrame) -> DataFrame:
    """(cid, hashes) from the texts of chosen documents."""

    def run(batches):
        for b in batches:
            found = shingle_sets(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in found], pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["cid", "hashes"])

    return map_arrow(docs.select(text_string()), run, "cid binary, hashes array<long>").where("cid is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), TREES * DEPTH)


class Forest:
    """The classes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, ws: Workspace):
        self.docs, self.ws = docs, ws
        self.sets = ws.write(document_sets(docs), "documents")
        full = self.sets.where("cid is not null")
        # A class's members have one signature, so any row's will do.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
        self.classes = ws.write(full.groupBy("cid").agg(first, F.max("n_shingles").alias("n"), F.max("signature").alias("signature")), "classes")

    def sketches(self) -> DataFrame:
        def run(batches):
            for b in batches:
                low = [x[::4] for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary())], ["cid", "sketch"])

        return self.classes.select("cid", "signature").mapInArrow(run, "cid binary, sketch binary")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(a, b): distinct pairs; (region, cid, n): members of wide regions and of those at the ends of sorted runs."""
        ranges = range_count(self.classes.count() * TREES, *RANGE_ROWS)
        order = ["region", "deep", "cid"]
        trees = forest_rows(self.classes).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        found = self.ws.write(map_arrow(trees, _neighbours, _FOUND), "found")
        pairs = found.where("a is not null").select("a", "b").distinct()
        return pairs, found.where("member is not null").select("region", F.col("member").alias("cid"), "n")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sketches agree in ALIKE places or more."""
        sketches = self.ws.write(self.sketches(), "sketches")
        left, right = (sketches.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")

        def run(batches):
            for b in batches:
                if b.num_rows:
                    same = (_matrix(b.column(2)) == _matrix(b.column(3))).sum(axis=1)
                    yield b.select([0, 1]).filter(pa.array(same >= ALIKE))

        met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb")
        return map_arrow(met, run, "a binary, b binary")

    def sets_of(self, ids: DataFrame, label: str) -> DataFrame:
        """(cid, hashes) of the classes in ``ids`` (cid), made anew from their first documents' texts."""
        firsts = self.classes.join(ids, "cid", "left_semi").select(F.col("first.doc_id").alias("id"), "first.version").distinct()
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("own"))
        texts = rows.join(firsts.hint("merge"), F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("version")), "left_semi")
        return self.ws.write(_texts_of(texts).join(ids, "cid", "left_semi").dropDuplicates(["cid"]), f"sets-{label}")

    def confirmed(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs that their full sets link, with their other columns."""
        ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
        sets = self.sets_of(ids, label)
        left = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("_x"))
        right = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("_y"))
        met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        met = met.select(*pairs.columns, F.size(F.array_intersect("_x", "_y")).cast("long").alias("_i"), (F.size("_x") + F.size("_y")).cast("long").alias("_s"))
        out = self.ws.write(met.where(f"100 * _i >= {PERCENT} * (_s - _i)").select(*pairs.columns), f"links-{label}")
        self.ws.drop(f"sets-{label}")
        return out

    def labelled(self, frame: DataFrame, roots: DataFrame, column: str, into: str) -> DataFrame:
        to = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return frame.join(to, column, "left").withColumn(into, F.coalesce("_root", column)).drop("_root")

    def merged(self, roots: DataFrame, links: DataFrame, label: str) -> DataFrame:
        """The roots after ``links`` between components (ra, rb) are added."""
        if links.isEmpty():
            return roots
        step = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.ws, label)
        to = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        moved = roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        fresh = step.join(roots.select("node"), "node", "left_anti")
        return self.ws.write(moved.union(fresh.select("node", "root")), f"{label}-merged")

    def roots(self) -> DataFrame:
        """(node, root) of every linked class."""
        ws = self.ws
        pairs, members = self.candidates()
        rank = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        ranked = ws.write(self.alike(pairs).withColumn("_k", rank), "ranked")
        first = self.confirmed(ranked.where("_k = 1").select("a", "b"), "first")
        roots = components(first, ws, "first")
        rest = self.labelled(self.labelled(ranked.where("_k > 1").select("a", "b"), roots, "a", "ra"), roots, "b", "rb")
        rest = ws.write(rest.where("ra <> rb"), "rest")
        if not rest.isEmpty():
            roots = self.merged(roots, self.confirmed(rest, "rest"), "second")
        wide = ws.write(self.wide(members, roots), "wide")
        if not wide.isEmpty():
            roots = self.merged(roots, wide, "third")
        return roots

    def wide(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """(ra, rb): components that a link within a wide region joins, one end outside the region's largest component."""
        ws = self.ws
        named = ws.write(self.labelled(members.distinct(), roots, "cid", "root"), "members")
        sizes = named.groupBy("region", "root").agg(F.count("*").alias("_size"))
        regions = sizes.groupBy("region").agg(F.max_by("root", F.struct("_size", "root")).alias("_main"), F.sum("_size").alias("_all"), F.max("_size").alias("_most"))
        mixed = regions.where("_most < _all").withColumn("_out", F.col("_all") - F.col("_most")).drop("_most")
        # A region may hold a third of all classes, so its rows are dealt by a salt.
        salted = mixed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = ws.write(named.withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["region", "_salt"]).drop("_salt"), "mixed")
        sketches = ws.spark.read.schema("cid binary, sketch binary").parquet(f"{ws.path}/sketches")

        def packed(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(np.array(x, np.int64)).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["cid", "hashes"])

        sets = map_arrow(self.sets_of(named.select("cid").distinct(), "mixed"), packed, "cid binary, hashes binary")
        rows = named.join(sketches.hint("merge"), "cid").join(sets.hint("merge"), "cid")
        # A block of the region's classes meets a block of those outside its largest component.
        part = lambda total: f"cast(pmod(xxhash64(cid), ceil({total} / {BLOCK})) as int)"
        every = lambda total: F.explode(F.expr(f"sequence(0, cast(ceil({total} / {BLOCK}) as int) - 1)"))
        columns = ("region", "cid", "root", "n", "sketch", "hashes")
        inside = rows.select(*columns, F.expr(part("_all")).alias("i"), every("_out").alias("j"), F.lit(False).alias("asks"))
        outside = rows.where("root <> _main").select(*columns, every("_all").alias("i"), F.expr(part("_out")).alias("j"), F.lit(True).alias("asks"))
        blocks = inside.unionByName(outside).groupBy("region", "i", "j")
        return blocks.applyInArrow(_compare, "ra binary, rb binary").distinct()


def _compare(t: pa.Table) -> pa.Table:
    """The components that some pair of a block links: sketches first, then full sets."""
    t = t.combine_chunks()
    asks = t.column("asks").to_numpy()
    root, n = np.array(t.column("root").to_pylist(), object), t.column("n").to_numpy()
    m, raw = _matrix(t.column("sketch").combine_chunks()), t.column("hashes").to_pylist()
    x = np.flatnonzero(~asks)
    joined: set[tuple] = set()
    for i in np.flatnonzero(asks).tolist():
        near = (100 * np.minimum(n[x], n[i]) >= PERCENT * np.maximum(n[x], n[i])) & (root[x] != root[i])
        y = x[near]
        mine = None
        for k in y[(m[y] == m[i]).sum(axis=1) >= ALIKE].tolist():
            pair = (min(root[i], root[k]), max(root[i], root[k]))
            if pair in joined:
                continue
            if mine is None:
                mine = np.frombuffer(raw[i], np.int64)
            other = np.frombuffer(raw[k], np.int64)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(mine) + len(other) - both):
                joined.add(pair)
    a, b = zip(*sorted(joined), strict=True) if joined else ((), ())
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["ra", "rb"])


def _components(forest: Forest, ws: Workspace) -> DataFrame:
    """cid and first, the first document of its component (none, doc_id, version), of each class."""
    named = forest.labelled(forest.classes.select("cid", "first"), forest.roots(), "cid", "root")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return ws.write(named.select("cid", "root").join(least, "root").select("cid", "first"), "labels")


def cluster(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    forest = Forest(docs, ws)
    labels = _components(forest, ws).select("cid", F.col("first.doc_id").alias("least"))
    rows = forest.sets.select("doc_id", "n_shingles", "cid").join(labels.hint("merge"), "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def dedup(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The first document of each component (by doc_id, null last, then by a hash of the text), and all texts without words, in the columns of ``docs``.

    Equal rows of a document that stays become one.
    """
    firsts = _components(Forest(docs, ws), ws).select("first.doc_id", "first.version").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    wordless = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("own"), wordless.alias("wordless"))
    met = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("version"))
    kept = rows.where("not wordless").join(firsts.hint("merge"), met, "left_semi").dropDuplicates(["id", "own"])
    return rows.where("wordless").union(kept).select("row.*")
