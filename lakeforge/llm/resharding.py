"""Resharding by minimum-cost flow: move the fewest bytes from an old layout to new shards.

The old layout has OLD_SHARDS shards by a hash of doc_id (or as a column ``given`` says, null being 0), each stored in blocks, a file a block, of
about BLOCK_BYTES by a hash of the document. From the shards' sizes and the new capacities (equal to
within a byte) a minimum-cost flow says how many bytes each old shard sends to each new one; keeping
bytes in place costs nothing, moving them costs one a byte. All blocks of a shard cost the same, so the
shards' flow is the blocks' flow added up, and cutting each old shard along its order of blocks into one run for
each new shard gives block transfers of the same, least cost. Whole blocks are handed over as they are;
only the blocks through which a cut passes, fewer than old and new shards together, are split document by
document.

``transfer`` does it on files: it writes the old layout (a folder a block), rewrites the cut blocks below
the new shards, and commits a manifest that names the owner of each block; only then are the old copies of cut
blocks deleted. ``read`` takes sizes, checksums, shards and slots from the files that the manifest lists.

Cuts miss by up to half a document each. ``_evened`` then lets single documents of cut blocks change shards, each the
one nearest in size to what is still uneven, found among all documents of those blocks; they are rewritten in any case.

What reaches the driver is one row a block. Windows run within one block, and stream.

Null text has no bytes (size 1) and crc32 0; a null doc_id is hashed like any other value.
Repeated rows are placed one by one and may lie side by side. Documents with equal texts are placed by doc_id, so
a group of copies spreads over the shards. Extra columns travel in a struct and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Workspace

OLD_SHARDS = 6
NEW_SHARDS = 8
BLOCK_BYTES = 64 << 20
LEAST_BLOCKS = 16
ROUNDS = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Flow from old to new shards by successive cheapest augmenting paths (Bellman-Ford on the residual graph)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, most: int, price: int) -> None:
        graph[u].append([v, most, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, min(s, capacity[j]), cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left = sum(supply)
    while left:
        far: list[float] = [float("inf")] * len(graph)
        back: list[tuple[int, int] | None] = [None] * len(graph)
        far[source], queue = 0, [source]
        while queue:
            u = queue.pop(0)
            for k, (v, most, price, _) in enumerate(graph[u]):
                if most and far[u] + price < far[v]:
                    far[v], back[v] = far[u] + price, (u, k)
                    queue.append(v)
        if back[sink] is None:
            raise ValueError("the new shards hold less than the old ones")
        amount, v = left, sink
        while v != source:
            u, k = back[v]
            amount, v = min(amount, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = back[v]
            graph[u][k][1] -= amount
            graph[v][graph[u][k][3]][1] += amount
            v = u
        left -= amount
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, back_at in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][back_at][1]
    return flow


def _size(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long") + 1


def _crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def old_layout(docs: DataFrame, old_shards: int, blocks: int, given: str | None = None) -> DataFrame:
    """row (all columns of the document), size, text_crc32, block: blocks are numbered through, ``blocks`` a shard."""
    h = F.xxhash64("doc_id")
    old = F.pmod(F.coalesce(F.col(given).cast("int"), F.lit(0)) if given else h, F.lit(old_shards))
    block = old * blocks + F.pmod(F.xxhash64(h, F.xxhash64("text")), F.lit(blocks))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _size("text").alias("size"), _crc("text").alias("text_crc32"), block.cast("int").alias("block"))


def plan(sizes: dict[int, int], blocks: int, new_shards: int) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]], int]:
    """From the blocks' bytes: the owner of each whole block, the runs [(end within the block, new shard)] of each cut block, and the flow's cost."""
    total: dict[int, int] = {}
    for b, n in sizes.items():
        total[b // blocks] = total.get(b // blocks, 0) + n
    olds, all_bytes = sorted(total), sum(total.values())
    capacity = [all_bytes // new_shards + (j < all_bytes % new_shards) for j in range(new_shards)]
    flow = min_cost_flow([total[o] for o in olds], capacity, lambda i, j: int(olds[i] != j))
    owner: dict[int, int] = {}
    cut: dict[int, list[tuple[int, int]]] = {}
    at = {o: 0 for o in olds}
    runs = {}
    for i, o in enumerate(olds):
        # What stays comes first; then the runs that leave, by target.
        end, runs[o] = 0, []
        for j in sorted((j for j in range(new_shards) if flow[i][j]), key=lambda j: (j != o, j)):
            end += flow[i][j]
            runs[o].append((end, j))
    for b in sorted(sizes):
        o, n = b // blocks, sizes[b]
        mine = [(min(end - at[o], n), j) for k, (end, j) in enumerate(runs[o]) if end > at[o] and (runs[o][k - 1][0] if k else 0) < at[o] + n]
        if len(mine) == 1:
            owner[b] = mine[0][1]
        else:
            cut[b] = mine
        at[o] += n
    return owner, cut, sum(flow[i][j] for i, o in enumerate(olds) for j in range(new_shards) if j != o)


_ORDER = ("row.doc_id", "text_crc32", "size")


def _placed(cut_rows: DataFrame, cut: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Rows of cut blocks with seq, their place in the block, and shard: where a document's middle byte lies, so a cut is missed by half a document at most."""
    runs = cut_rows.sparkSession.createDataFrame(list(cut.items()), "block int, runs array<struct<end: long, shard: int>>")
    order = Window.partitionBy("block").orderBy(*_ORDER)
    rows = cut_rows.withColumn("seq", F.row_number().over(order)).withColumn("begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    shard = F.expr("coalesce(element_at(filter(runs, r -> 2 * r.end > 2 * begin + size), 1).shard, element_at(runs, -1).shard)")
    return rows.join(F.broadcast(runs), "block").withColumn("shard", shard).drop("runs", "begin")


def _evened(placed: DataFrame, off: dict[int, int]) -> list[tuple[int, int, int]]:
    """(block, seq, new shard) of documents of cut blocks that even out what the cuts missed; ``off`` is each shard's bytes over its capacity."""
    moves: list[tuple[int, int, int]] = []
    for _ in range(ROUNDS):
        over, under = sorted((j for j in off if off[j] > 0), key=lambda j: -off[j]), sorted((j for j in off if off[j] < 0), key=off.get)
        pairs = {o: u for o, u in zip(over, under, strict=False)}
        if not pairs:
            break
        want = F.coalesce(*(F.when(F.col("shard") == o, F.lit(min(off[o], -off[u]))) for o, u in pairs.items()))
        rest = placed.where(F.col("shard").isin(list(pairs)))
        for block in {b for b, _, _ in moves}:
            rest = rest.where((F.col("block") != block) | ~F.col("seq").isin([s for b, s, _ in moves if b == block]))
        best = rest.groupBy("shard").agg(F.min(F.struct(F.abs(F.col("size") - want).alias("miss"), "block", "seq", "size")).alias("x")).collect()
        found = False
        for r in sorted(best, key=lambda r: r.shard):
            o, u, n = r.shard, pairs[r.shard], r.x["size"]
            if max(abs(off[o] - n), abs(off[u] + n)) < max(off[o], -off[u]):
                off[o], off[u], found = off[o] - n, off[u] + n, True
                moves.append((r.x.block, r.x.seq, u))
        if not found:
            break
    return moves


@dataclass
class Layout:
    """The new layout below a workspace: ``manifest`` has (shard, block) of the whole blocks; ``cost`` is the least number of bytes to move."""

    ws: Workspace
    manifest: DataFrame
    row: StructType
    blocks: int
    cost: int
    cut: list[int]


def _files(layout: Layout, name: str) -> DataFrame:
    folder = {"old": "block", "new": "shard"}[name]
    inside = [StructField("row", layout.row), StructField("size", LongType()), StructField("text_crc32", LongType()), *([StructField("block", IntegerType())] if name == "new" else [])]
    return layout.ws.spark.read.schema(StructType([*inside, StructField(folder, IntegerType())])).parquet(f"{layout.ws.path}/{name}")


def transfer(docs: DataFrame, ws: Workspace, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, *, block_bytes: int = BLOCK_BYTES, least: int = LEAST_BLOCKS, given: str | None = None) -> Layout:
    """Reshard on files below ``ws``: whole blocks stay where they are and change owner, cut blocks are written anew."""
    spark = docs.sparkSession
    all_bytes = docs.agg(F.sum(_size("text"))).first()[0] or 0
    blocks = max(least, -(-all_bytes // (old_shards * block_bytes)))
    laid = old_layout(docs, old_shards, blocks, given)
    layout = Layout(ws, None, laid.schema["row"].dataType, blocks, 0, [])
    laid.repartitionById(old_shards * blocks, F.col("block")).sortWithinPartitions("block", *_ORDER).write.option("compression", "zstd").partitionBy("block").parquet(f"{ws.path}/old")
    old = _files(layout, "old")
    sizes = {r.block: r.bytes for r in old.groupBy("block").agg(F.sum("size").alias("bytes")).collect()}
    owner, cut, layout.cost = plan(sizes, blocks, new_shards)
    layout.cut = sorted(cut)
    cut_rows = old.where(F.col("block").isin(layout.cut))  # folders of other blocks aren't read
    placed = ws.write(_placed(cut_rows.select(F.struct("row.doc_id").alias("row"), "size", "text_crc32", "block"), cut).select("block", "seq", "size", "shard"), "placed")
    total = sum(sizes.values())
    off = {j: -(total // new_shards + (j < total % new_shards)) for j in range(new_shards)}
    for b, j in owner.items():
        off[j] += sizes[b]
    for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        off[r.shard] += r.bytes
    moves = spark.createDataFrame(_evened(placed, off), "block int, seq int, to int")
    again = _placed(cut_rows, cut).join(F.broadcast(moves), ["block", "seq"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("seq", "to")
    again.repartitionById(new_shards, F.col("shard")).sortWithinPartitions("shard", "block", *_ORDER).write.option("compression", "zstd").partitionBy("shard").parquet(f"{ws.path}/new")
    layout.manifest = ws.write(spark.createDataFrame([(j, b) for b, j in sorted(owner.items())], "shard int, block int").coalesce(1), "manifest")
    ws.drop("placed", *(f"old/block={b}" for b in layout.cut))
    return layout


def read(layout: Layout, *, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block, shard, slot, moved, from the files of the new layout; with ``whole`` also ``row``.

    Slots go by block within the shard, then by document within the block.
    """
    rows = _files(layout, "old").join(layout.manifest, "block").select("row", "block", "shard").unionByName(_files(layout, "new").select("row", "block", "shard"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = counts.select("shard", "block", before.alias("before"))
    found = rows.select(F.col("row.doc_id").alias("doc_id"), _size("row.text").alias("size"), _crc("row.text").alias("text_crc32"), "block", "shard", *(["row"] if whole else []))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    old = F.expr(f"cast(block div {layout.blocks} as int)")
    return found.withColumn("place", place).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", old.alias("old_shard"), "block", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), (F.col("shard") != old).alias("moved"), *(["row"] if whole else [])
    )
