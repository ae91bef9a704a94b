"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt into cells by the bit counts of their blocks of bits. Fingerprints within the radius
lie in cells whose counts differ by no more than the radius in sum, so all other cell pairs are skipped; what is left
is compared exactly, tile by tile, with exclusive-or and bit counts. A tile pair passes on a spanning forest of the
links that it finds, never all pairs of a group.

With a Jaccard similarity, the cells are the elements of the prefixes of the sets of shingles: two sets of that similarity
share one. Within a cell fingerprints are compared as before, tile by tile, with a radius so wide that it misses next to
nothing, and every pair that is left is verified on its sets; fingerprints alone link nothing.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.bpe import blocks as text_blocks
from corpusforge.llm.common import bit_filter, may_have, save, text_of

SHINGLE_WORDS = 5
RADIUS = 12
JACCARD = 0.8
#: Fingerprints on either side of a tile pair.
HOME_TILE = 8192
VISITOR_TILE = 32768
#: Links held before they are cut down to a forest.
LINKS = 1 << 20
#: Comparisons with one set of all that share an element, if more sets do, before all pairs left are compared.
HUB_ROUNDS, HUB_NODES = 2, 64
#: Fingerprints of two sets of a similarity of 0.8 differ in 9.7 bits on average, in more than SIMILAR_BITS for 3 pairs in a
#: million. Those of sets of fewer than SMALL_SET shingles say less; they don't count.
SIMILAR_BITS, SMALL_SET = 24, 32
#: Nodes of a cell that are compared in one task, with as many others of it.
CELL_TILE = 8192
#: Counters in either half of the table that orders the elements of sets: its size doesn't depend on the input.
COUNTERS = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _hashes(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, and how many each text has."""
    hashes: list[int] = []
    counts = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(words) <= shingle:
            found = [_hash(b" ".join(words))] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = [0, *ends[:-shingle].tolist()]
            found = [_hash(joined[i:j]) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        hashes += found
        counts.append(len(found))
    return np.array(hashes, dtype="<u8"), np.array(counts, dtype=np.int64)


def _majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    result = np.zeros(len(sizes), dtype="<u8")
    full = np.flatnonzero(sizes)
    if len(full):
        ones = np.zeros((len(full), 64), dtype=np.int64)
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k in range(8):  # a byte of the hashes at a time
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8)[:, k : k + 1], axis=1, bitorder="little")
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        majority = ones * 2 > sizes[full][:, None]
        result[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return result


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (long, the 64 bits as a signed number) of each whole text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A bit is set if over half of the shingles' XXH64 values
    (seed 42, repeats included) have it. A text of fewer words has one shingle of all of them; null and wordless texts
    have fingerprint 0.
    """

    def run(batches):
        for part, texts in text_blocks(batches):
            bits = _majority(*_hashes(texts, shingle)).view("<i8")
            yield pa.record_batch([part["doc_id"], pa.array(bits)], names=["doc_id", "fingerprint"])

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return columns.mapInArrow(run, "doc_id long, fingerprint long")


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, nodes: int) -> np.ndarray:
    """Indices of the links a-b of length d that form a minimum spanning forest."""
    label = np.arange(nodes)
    chosen = []
    for length in np.unique(d):
        left = np.flatnonzero(d == length)
        while True:
            x, y = label[a[left]], label[b[left]]
            apart = x != y
            left, x, y = left[apart], x[apart], y[apart]
            if not len(left):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            parent = np.arange(nodes)
            parent[high] = np.minimum(x, y)[first]
            chosen.append(left[first])
            while not np.array_equal(parent, grand := parent[parent]):
                parent = grand
            label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _compare(homes: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest of all links between homes and visitors, as values and lengths."""
    values, index = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    home_index, visitor_index = index[: len(homes)], index[len(homes) :]
    held = [np.zeros(0, dtype=np.int64)] * 3
    rows = max(1, (1 << 20) // max(1, len(visitors)))
    parts, size = [held], 0

    def reduced():
        a, b, d = (np.concatenate(x) for x in zip(*parts))
        keep = forest(a, b, d, len(values))
        return [a[keep], b[keep], d[keep]]

    for i in range(0, len(homes), rows):
        distance = np.bitwise_count(homes[i : i + rows, None] ^ visitors[None, :])
        h, v = np.nonzero(distance <= radius)
        length = distance[h, v].astype(np.int64)
        h, v, length = (x[length > 0] for x in (h, v, length))
        parts.append([home_index[i + h], visitor_index[v], length])
        size += len(h)
        if size > LINKS:
            parts = [reduced()]
            size = len(parts[0][0])
    a, b, d = reduced()
    return values[a], values[b], d


def _offsets(blocks: int, radius: int, radix: int) -> list[int]:
    """Cell differences of half the neighbourhood: vectors of sum at most radius whose first non-zero part is positive, and zero."""
    vectors = [v for v in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, v)) <= radius]
    return [sum(x * radix**i for i, x in enumerate(v)) for v in vectors if next((x for x in v if x), 1) > 0]


def links(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """a, b, d: links between the fingerprints of distinct that connect all within radius, a forest for each tile pair.

    blocks: into how many blocks of bits a fingerprint is cut for its cell; more skip more but send each fingerprint to
    more cells, so many blocks suit small radii.
    """
    width = 64 // blocks
    radix = width + 1 + 2 * radius
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    cell = sum(
        (F.bit_count(F.shiftrightunsigned("fingerprint", i * width).bitwiseAND(mask)) + radius).cast("long") * radix**i
        for i in range(blocks)
    )
    offsets = F.array(*[F.lit(o).cast("long") for o in _offsets(blocks, radius, radix)])
    prints = distinct.select("fingerprint", cell.alias("cell"))
    # At most (64 / blocks + 1) ** blocks rows whatever the input, so they may be broadcast.
    cells = save(prints.groupBy("cell").agg(F.count(F.lit(1)).alias("homes")), "cells")
    reach = cells.select(F.explode(F.transform(offsets, lambda o: F.col("cell") + o)).alias("home"), "homes")
    visited = reach.groupBy("home").agg(F.sum("homes").alias("visitors"))
    layout = cells.join(visited, F.col("cell") == F.col("home")).select(
        "home",
        F.ceil(F.col("homes") / HOME_TILE).cast("int").alias("home_tiles"),
        F.ceil(F.col("visitors") / VISITOR_TILE).cast("int").alias("visitor_tiles"),
    )
    layout = F.broadcast(save(layout, "layout"))
    tile = lambda n: F.pmod(F.xxhash64(F.col("fingerprint"), F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    homes = prints.join(layout, F.col("cell") == F.col("home")).select(
        "home", tile("home_tiles").alias("h"), each("visitor_tiles").alias("v"), F.lit(0).alias("role"), "fingerprint"
    )
    visitors = prints.select("fingerprint", F.explode(F.transform(offsets, lambda o: F.col("cell") + o)).alias("at"))
    visitors = visitors.join(layout, F.col("at") == F.col("home")).select(
        "home", each("home_tiles").alias("h"), tile("visitor_tiles").alias("v"), F.lit(1).alias("role"), "fingerprint"
    )

    def run(batches):
        key, sides = None, ([], [])

        def close():
            homes_, visitors_ = (np.concatenate(s) if s else np.zeros(0, dtype=np.uint64) for s in sides)
            a, b, d = _compare(homes_, visitors_, radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            home, h, v, role = (batch[c].to_numpy(zero_copy_only=False) for c in ("home", "h", "v", "role"))
            values = batch["fingerprint"].to_numpy(zero_copy_only=False).view(np.uint64)
            changes = np.flatnonzero((np.diff(home) != 0) | (np.diff(h) != 0) | (np.diff(v) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *changes.tolist()], [*changes.tolist(), len(home)]):
                this = (home[i], h[i], v[i])
                if this != key:
                    if key is not None:
                        yield close()
                    key, sides = this, ([], [])
                sides[role[i]].append(values[i:j].copy())
        if key is not None:
            yield close()

    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sides = homes.unionByName(visitors).repartition(tasks, "home", "h", "v").sortWithinPartitions("home", "h", "v", "role")
    return sides.mapInArrow(run, "a long, b long, d int")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b: long) that isn't the smallest of its component, that smallest one.

    Alternates large and small stars; the driver sees only a count and a checksum of each round.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    known = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = save(small.select("e.*").filter("u <> v").distinct(), "edges")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """row, shingles (sorted distinct hashes) of docs (row, text)."""

    def run(batches):
        for part, texts in text_blocks(batches):
            values, sizes = _hashes(texts, shingle)
            sets = [np.unique(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view("<i8")))
            yield pa.record_batch([part["row"], shingles], names=["row", "shingles"])

    return docs.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in either half."""
    return tuple((shingles >> np.uint64(k) & np.uint64(COUNTERS - 1)).astype(np.int64) + k // 32 * COUNTERS for k in (0, 32))


def _counted(docs: DataFrame, shingle: int) -> np.ndarray:
    """Occurrences in all texts of docs (row, text), by counter. The smaller of its two counters is at least what a shingle
    has; it only orders the sets, so no pair is lost if others share them."""

    def run(batches):
        counts = np.zeros(2 * COUNTERS, dtype=np.int64)
        for _, texts in text_blocks(batches):
            for places in _places(_hashes(texts, shingle)[0]):
                counts += np.bincount(places, minlength=2 * COUNTERS)
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["place", "n"])

    # At most 2 * COUNTERS rows for a task and for the driver, whatever the input.
    found = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * COUNTERS, dtype=np.int64)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    return counts


def _signatures(docs: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """row, doc_id, fingerprint, node, size, prefix of docs (row, doc_id, text).

    node: a hash of the set of shingles; fingerprint: that of the set, each shingle once; size: its elements. prefix: its
    first elements, rare ones first, so many that two sets of this similarity share one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_counted(docs, shingle))

    def run(batches):
        counts = shared.value
        for part, texts in text_blocks(batches):
            values, sizes = _hashes(texts, shingle)
            sets = [np.unique(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
            lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            bits = _majority(np.concatenate(sets), lengths).view("<i8")
            nodes, prefixes = [_hash(v.tobytes()) for v in sets], []
            for v in sets:
                first, second = _places(v)
                v = v[np.minimum(counts[first], counts[second]).argsort(kind="stable")]
                prefixes.append(v[: len(v) - math.ceil(jaccard * len(v) - 1e-9) + 1])
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes).view("<i8")))
            columns = [part["row"], part["doc_id"], pa.array(bits), pa.array(np.array(nodes, dtype="<u8").view("<i8")), pa.array(lengths, pa.int32()), prefix]
            yield pa.record_batch(columns, names=["row", "doc_id", "fingerprint", "node", "size", "prefix"])

    return docs.mapInArrow(run, "row long, doc_id long, fingerprint long, node long, size int, prefix array<long>")


def _near_in_cells(c: dict[str, np.ndarray], jaccard: float) -> tuple[np.ndarray, ...]:
    """Pairs of rows of whole cells that may be similar: nodes a < b and their sizes. c: columns, sorted by cell (token, low,
    high) and population count."""
    n = len(c["token"])
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = (np.diff(c["token"]) != 0) | (np.diff(c["low"]) != 0) | (np.diff(c["high"]) != 0)
    bounds = np.flatnonzero(new)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    prints, sizes, found = c["fingerprint"].view(np.uint64), c["size"], []
    ones = np.bitwise_count(prints).astype(np.int64)
    active, k = np.arange(n), 0
    while len(active):
        k += 1
        active = active[left[active] > k]
        a, b = active, active + k
        least, most = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        beyond = (ones[b] - ones[a] > SIMILAR_BITS) & (sizes[a] * jaccard >= SMALL_SET)
        near = (np.bitwise_count(prints[a] ^ prints[b]) <= SIMILAR_BITS) | (least < SMALL_SET)
        near &= (least >= jaccard * most - 1e-9) & (c["root"][a] != c["root"][b])
        near &= (c["low"][a] == c["high"][a]) | (c["tile"][a] != c["tile"][b])
        x, y = a[near], b[near]
        swap = c["node"][x] > c["node"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        found.append((c["node"][x], c["node"][y], sizes[x], sizes[y]))
        # Population counts ascend, so all further ones of the cell are beyond the radius too.
        active = active[~beyond]
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (c["node"][:0], c["node"][:0], sizes[:0], sizes[:0])


def _near(members: DataFrame, jaccard: float) -> DataFrame:
    """a, b, a_size, b_size: pairs of members (token, n, node, size, fingerprint, root) of a cell that may be similar and have
    different roots, a row for each cell. Cells of more than CELL_TILE nodes are cut into tiles; every two meet in a task."""
    names = ["token", "low", "high", "tile", "node", "size", "fingerprint", "root"]

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is None:
                whole, held = held, None
            else:
                now = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
                whole = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in names}
                if not len(whole["token"]):
                    continue
                # The last cell may go on in the next batch.
                last = np.logical_and.reduce([whole[c] == whole[c][-1] for c in ("token", "low", "high")])
                cut = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
                held, whole = {c: v[cut:] for c, v in whole.items()}, {c: v[:cut] for c, v in whole.items()}
            if whole is not None and len(whole["token"]):
                found = _near_in_cells(whole, jaccard)
                yield pa.record_batch([pa.array(f) for f in found], names=["a", "b", "a_size", "b_size"])

    tiles = F.ceil(F.col("n") / CELL_TILE).cast("int")
    rows = members.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).select(names)
    spark = members.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "token", "low", "high").sortWithinPartitions("token", "low", "high", F.bit_count("fingerprint"))
    return rows.mapInArrow(run, "a long, b long, a_size int, b_size int")


def _passed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """Those pairs a, b of nodes whose sets of shingles have at least this Jaccard similarity; rows: a row of each node."""
    pairs = save(pairs.select("a", "b"), "candidates")
    ends = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(rows, "node").select("node", "row"), "ends")
    wanted = ends.select("row").distinct()
    texts = may_have(docs, "row", bit_filter(wanted, "row")).join(wanted, "row").dropDuplicates(["row"])
    sets = save(_sets(texts, shingle).join(ends, "row").select("node", "shingles"), "shingles")
    x, y = (sets.withColumnsRenamed({"node": n, "shingles": s}) for n, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(x, "a").join(y, "b")
    return joined.filter(common + 1e-9 >= jaccard * (F.size("x") + F.size("y") - common)).select("a", "b")


def similar(docs: DataFrame, prints: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """a, b: links that connect all nodes of prints whose sets have at least this Jaccard similarity.

    Two such sets share an element of their prefixes, which is their cell. Where more than HUB_NODES nodes share one, they
    are first compared with one of them (HUB_ROUNDS times with another one), so that a large group costs a row a node. Then
    every pair that isn't connected yet is a candidate if its fingerprints and sizes are near and its sets may have enough in
    common: what their prefixes share and what lies behind the longer rest of them. Candidates are verified exactly.
    """
    kept = ["fingerprint", "size", "prefix"]
    sets = prints.groupBy("node").agg(F.min("row").alias("row"), *[F.any_value(c).alias(c) for c in kept])
    sets = save(sets, "sets")
    rows, features = sets.select("node", "row"), sets.select("node", "size", "fingerprint")
    tokens = sets.select("node", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = save(tokens.join(shared, "token"), "members")
    bits = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other_fingerprint")))
    least, most = F.least("size", "other_size"), F.greatest("size", "other_size")
    near = (least >= jaccard * most - 1e-9) & ((bits <= SIMILAR_BITS) | (least < SMALL_SET))
    ends = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    others = [F.col(c).alias(o) for c, o in (("node", "other"), ("size", "other_size"), ("fingerprint", "other_fingerprint"), ("root", "other_root"))]
    found, nodes = None, features.withColumn("root", F.col("node"))
    for n in range(HUB_ROUNDS):
        large = members.filter(F.col("n") > HUB_NODES).join(nodes, "node")
        hubs = large.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(n)).alias("h"), *others)).alias("hub"))
        pairs = large.join(hubs.select("token", "hub.*").drop("h"), "token")
        pairs = pairs.filter((F.col("root") != F.col("other_root")) & near).select(*ends).distinct()
        passed = _passed(pairs, rows, docs, shingle, jaccard)
        found = save(passed if found is None else found.unionByName(passed), "links")
        roots = components(found).withColumnRenamed("root", "found")
        nodes = save(features.join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found"), "nodes")
    # Cells whose nodes are all connected by now have nothing left to compare.
    labelled = save(members.join(nodes, "node"), "labelled")
    split = labelled.groupBy("token").agg(F.min("root").alias("lowest"), F.max("root").alias("highest")).filter("lowest <> highest").select("token")
    labelled = labelled.join(split, "token")
    # A set's elements behind its prefix: one less than it must have in common.
    behind = lambda c: F.greatest(F.ceil(F.col(c) * jaccard - 1e-9) - 1, F.lit(0))
    most = F.count(F.lit(1)) + F.greatest(behind("a_size"), behind("b_size"))
    least = jaccard / (1 + jaccard) * (F.col("a_size") + F.col("b_size")) - 1e-6
    pairs = _near(labelled, jaccard).groupBy("a", "b", "a_size", "b_size").agg(most.alias("most")).filter(F.col("most") >= least)
    return found.unionByName(_passed(pairs, rows, docs, shingle, jaccard))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, jaccard: float | None = JACCARD, blocks: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (long), component_id: smallest doc_id reachable over links, one row per input row.

    With jaccard, texts link if their sets of shingles have at least that similarity (all such pairs count, but for those
    that SIMILAR_BITS misses), and fingerprint is that of the set. Without, fingerprints link if at most `radius` bits differ. Texts without words are equal. Ids
    should be unique; a component of null ids only has a null component_id. An empty table gives no rows. Other columns
    are ignored.
    """
    if jaccard is None:
        prints = save(fingerprints(docs, shingle, text, doc_id).withColumn("node", F.col("fingerprint")), "fingerprints")
    else:
        ids, content = F.col(doc_id).cast("long"), text_of(text)
        rows = docs.select(F.xxhash64(ids, content).alias("row"), ids.alias("doc_id"), content.alias("text"))
        prints = save(_signatures(rows, shingle, jaccard), "signatures")
    owners = save(prints.groupBy("node").agg(F.min("doc_id").alias("owner")), "owners")
    if jaccard is None:
        edges = links(owners.withColumnRenamed("node", "fingerprint"), radius, blocks or (4 if radius <= 2 else 1))
    else:
        edges = similar(rows.select("row", "text"), prints, shingle, jaccard)
    roots = components(edges)
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = linked.join(owners, "node")
    smallest = linked.groupBy("root").agg(F.min("owner").alias("component_id"))
    linked = linked.join(smallest, "root").select("node", "component_id")
    named = save(owners.join(linked, "node", "left").select("node", F.coalesce("component_id", "owner").alias("component_id")), "components")
    return prints.select("doc_id", "fingerprint", "node").join(named, "node").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with the smallest doc_id of each component; rows with a null id stay."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(docs.columns)
