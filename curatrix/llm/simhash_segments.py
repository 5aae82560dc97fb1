"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is mapped to 32 counts, one per 2-bit segment (0, 1 or 2 set bits). The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
a range join on the vectors loses no pair. For a range of d the vector is cut into
``d // 2 + 1`` sub-spaces; two vectors within d are then within 1 in at least one of them, so the
grid has unit cells per sub-space, and a fingerprint asks its own cell and the cells one count
above it (a neighbour below asks from its own side). What meets in a cell is verified exactly.

Copies collapse to one fingerprint first. Inside a cell links are followed breadth first: each
fingerprint taken from the queue is compared with those not reached yet only, so a dense group of
near copies costs little and leaves a spanning tree, never all pairs. A cell with very many
fingerprints is dealt out as pairs of blocks. Connected components over the tree edges give the
groups.

Several fingerprints of a text can be asked for: the first from the shingles' hashes, the others
from mixtures of these. Texts then link if any of them are within range, which finds more of the
near copies while each join keeps its narrow range. Texts with all fingerprints equal are one node,
named by the fingerprint, or by a 64-bit hash of several.

Defined results: a null or empty text has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; repeated rows each get a row; a null id keeps its row
and is never the smallest id unless its group has no other; an empty table gives no rows; only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import byte_words, cut_lineage, free_name, row_key, same_row, text_bytes
from curatrix.llm.components import connected_components

BITS = 64
SEGMENTS = 0x5555555555555555
#: Fingerprints of one cell that one task compares; cells with more are dealt out in blocks.
BLOCK = 4096
#: Rows of the table of large cells that may be broadcast (24 bytes each).
BROADCAST_ROWS = 100_000


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42, n: int = 1) -> list[int]:
    """``n`` signed 64-bit SimHashes of a text whose letters A-Z are lower-cased: a bit is set if
    more than half of the shingles' hashes have it."""
    words = byte_words(data.lower())
    if not words:
        return [0] * n
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(b" ".join(words), seed)], np.uint64)
    else:
        parts = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = np.fromiter((digest(b" ".join(p), seed) for p in parts), np.uint64, len(words) - shingle + 1)
    return [_majority(hashes if k == 0 else _mixed(hashes, k)) for k in range(n)]


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3, seed: int = 42, n: int = 1) -> DataFrame:
    """(key, row, fp, fps) for every row: ``row_key`` of the text, the first fingerprint, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x, shingle, seed, n) for x in text_bytes(batch, "text")]
            first = pa.array([x[0] for x in made], pa.int64())
            every = pa.array(made, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first, every], ["key", "row", "fp", "fps"])

    rows = docs.select(F.col(key).alias("key"), row_key(F.col(text)).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, row long, fp long, fps array<long>")


def embedding(fp: Column) -> Column:
    """The 32 segment counts, packed as 2 bits each: the number of set bits within every pair."""
    ones = F.lit(SEGMENTS)
    low, high = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _one_more(cell: Column, k: int) -> Column:
    """The cell with one more in segment ``k``; null where that count is 2 already."""
    count = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
    one, three = F.lit(1 << 2 * k), F.lit((3 << 2 * k) - (1 << BITS if k == 31 else 0))
    return F.when(count == 0, cell.bitwiseXOR(one)).when(count == 1, cell.bitwiseXOR(three))


def sub_spaces(distance: int) -> list[tuple[int, int]]:
    """(first segment, number of segments) of each sub-space for a range of ``distance``."""
    n = distance // 2 + 1
    edges = [round(32 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def cells(nodes: DataFrame, distance: int) -> DataFrame:
    """(space, cell, home, fp, node): the home cell of every fingerprint of ``nodes`` (node, fps) in
    every sub-space, and the cells one count above it. Each fingerprint's place has spaces of its
    own."""
    spaces = sub_spaces(distance)
    each = []
    for number, (first, n) in enumerate(spaces):
        own = F.shiftrightunsigned("packed", 2 * first)
        if n < 32:
            own = own.bitwiseAND(F.lit((1 << 2 * n) - 1))
        above = [_cell(number, _one_more(own, k), False) for k in range(n)]
        each += [_cell(number, own, True), *above]
    single = nodes.select("node", F.posexplode_outer("fps").alias("which", "fp"))
    wide = single.select("node", "which", "fp", embedding(F.col("fp")).alias("packed")).select("node", "which", "fp", F.explode_outer(F.array(*each)).alias("c"))
    space = F.col("which") * len(spaces) + F.col("c.space")
    return wide.filter("c.cell IS NOT NULL").select(space.alias("space"), "c.cell", "c.home", "fp", "node")


def _cell(space: int, cell: Column, home: bool) -> Column:
    return F.struct(F.lit(space).alias("space"), cell.alias("cell"), F.lit(home).alias("home"))


def _large_cells(nodes: DataFrame, distance: int, block: int) -> DataFrame:
    """(space, cell, blocks) of the cells that more than ``block`` nodes may ask. Few homes
    and all cells above a well-filled home are looked at; nothing else can fill a cell."""
    homes = cells(nodes, distance).filter("home").groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n"))
    least = max(1, block // 33)
    filled = homes.filter(F.col("n") > least)
    out = []
    spaces = sub_spaces(distance)
    for number, (_, n) in enumerate(spaces):
        here = filled.filter(F.col("space") % len(spaces) == number)
        above = F.array(F.col("cell"), *(_one_more(F.col("cell"), k) for k in range(n)))
        out.append(here.select("space", "n", F.explode(above).alias("cell")).filter("cell IS NOT NULL"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    load = every.groupBy("space", "cell").agg((F.sum("n") + 17 * least).alias("n")).filter(F.col("n") > block)
    return load.select("space", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def _spread(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Large cells become pairs of blocks; every pair of their rows meets in one of them."""
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0))
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    marked = rows.join(large, ["space", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = marked.select("space", "cell", "home", "fp", "node", "blocks", own.alias("own"), other.alias("other"))
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return paired.select("space", "cell", "home", "fp", "node", part.alias("part"))


def _tree(bits: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among nodes with these fingerprints (uint64)."""
    members, first, which = np.unique(bits, return_index=True, return_inverse=True)
    parents, children = [nodes[first[which]]], [nodes]
    at = nodes[first]
    while len(members) > 1:
        queue, members, others = [(members[0], at[0])], members[1:], at[1:]
        while queue and len(members):
            now, name = queue.pop()
            near = np.bitwise_count(members ^ now) <= distance
            if near.any():
                parents.append(np.full(int(near.sum()), name))
                children.append(others[near])
                queue.extend(zip(members[near], others[near], strict=True))
                members, others = members[~near], others[~near]
        at = others
    return parents, children


def _linker(distance: int):
    names = ("space", "cell", "part", "home", "fp", "node")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of whole groups: the last group of a batch waits for the next batch."""
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = int(np.argmax(last))
            rest = [c[cut:] for c in now]
            if cut:
                yield [c[:cut] for c in now]
        if rest is not None and len(rest[0]):
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for space, cell, part, home, fp, node in groups(batches):
            new = np.ones(len(fp), bool)
            new[1:] = (space[1:] != space[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(fp)))
            asked = np.add.reduceat(home.astype(np.int64), first) > 0
            bits = fp.astype(np.int64).view(np.uint64)
            pairs = first[asked & (size == 2)]
            pairs = pairs[np.bitwise_count(bits[pairs] ^ bits[pairs + 1]) <= distance]
            a, b = [node[pairs]], [node[pairs + 1]]
            for at, n in zip(first[asked & (size > 2)], size[asked & (size > 2)], strict=True):
                p, c = _tree(bits[at : at + n], node[at : at + n], distance)
                a += p
                b += c
            a, b = (np.concatenate(x).astype(np.int64) for x in (a, b))
            same = a == b
            yield pa.RecordBatch.from_arrays([pa.array(a[~same]), pa.array(b[~same])], ["a", "b"])

    return run


def links(nodes: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between ``nodes`` (node, fps) with a fingerprint at the same place within
    ``distance``, as many as keep everything connected which all such links connect."""
    rows = _spread(cells(nodes, distance), _large_cells(nodes, distance, block))
    dealt = rows.repartition("space", "cell", "part").sortWithinPartitions("space", "cell", "part")
    return dealt.mapInArrow(_linker(distance), "a long, b long")


def simhash_components(
    docs: DataFrame, key: str, text: str, shingle: int = 3, distance: int = 3, seed: int = 42, n: int = 1
) -> DataFrame:
    """(key, row, fp, component_id, root) for every row: ``row_key`` of the text, the first of ``n``
    fingerprints, the smallest key that links reach, and a name of the group."""
    named = F.col("fp") if n == 1 else F.xxhash64("fps")
    rows = cut_lineage(fingerprints(docs, key, text, shingle, seed, n).withColumn("node", named))
    distinct = cut_lineage(rows.groupBy("node").agg(F.min("key").alias("first"), F.min("fps").alias("fps")))
    roots = connected_components(links(distinct.select("node", "fps"), distance))
    rooted = distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select("node", "root", "component_id")
    return rows.select("key", "row", "fp", "node").join(found, "node").select(F.col("key").alias(key), "row", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, key: str, text: str, **how: int) -> DataFrame:
    """One row of ``docs`` of each group: that with the smallest key (null last), then ``row_key`` of
    the text; of rows that agree in both, the one whose columns are least."""
    made = simhash_components(docs, key, text, **how)
    first = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "row")).alias("first")
    kept = made.groupBy("root").agg(first).select(F.col("first.key").alias("kept_key"), F.col("first.row").alias("kept_row"))
    row = free_name(docs, "row")
    named = docs.withColumn(row, row_key(F.col(text)))
    held = named.join(kept, same_row(named, kept, key, row, "kept_key", "kept_row"), "left_semi")
    least = held.groupBy(key, row).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("whole"))
    return least.select(*(F.col(f"whole.`{c}`") for c in docs.columns))
