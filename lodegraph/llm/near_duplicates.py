"""MinHash near-duplicates with HyperMinHash registers.

A document's set is its distinct word shingles (64-bit hashes).  The set is
dealt over ``BUCKETS`` buckets; each bucket's smallest value is stored as a
register of a leading-zero count and ten mantissa bits.  For the bands an empty
bucket borrows the register of a filled one, chosen alike in all documents.
Bands of registers are hashed; documents that share a band meet.

1. Documents with equal sets collapse to one node, so groups of exact copies
   cost one node whatever their size.
2. Each band value joins its nodes to its smallest node only, never to each other.
   Connected components of these edges are families: every pair that shares a
   band is in one family.
3. In a small family all pairs are estimated from the stored registers, corrected
   for chance collisions.  Only nodes of a pair that can still be a link go on:
   their full sets are made and confirm the links.
4. In a family beyond ``FAMILY`` nodes or ``SHINGLES`` shingles nodes go whose
   shingles that no other member has already rule out any link; the rest is cut into
   chunks.  Every chunk is compared within itself and with up to ``HEADS`` heads of
   the family, which costs each node one row.  What this joins to the family's main
   component is done, since pairs within a component need no second look; the
   nodes left outside are compared with all chunks, in blocks.  A group of near
   copies thus costs its size, and only nodes that resemble it without belonging
   to it cost more.  Tasks return spanning forests instead of pairs.
5. Connected components of the confirmed links give the result.

The number of rows per band is chosen so that a pair at the threshold misses
all bands with a probability below ``MISS``.  A pair is dropped by its estimate
only where a pair at the threshold would show so few equal registers with a
probability below ``MISS`` (Chernoff's bound; the registers that either document
fills are a sample of the union without replacement).  All else is exact.

Defined cases: null, empty and wordless texts have no set and link with nothing;
texts with fewer words than a shingle are one shingle; rows that share an id
are one document, which links through each of its texts; rows without an id take
part like all others and belong to the component they link with, but are never
anyone's ``component_id`` (null where no member has an id); equal sets are ties,
and the smallest id stands for them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, WordHashes, chunks, materialise
from .components import components

BUCKETS = 384
MANTISSA = 10
#: A register that no value fills.
EMPTY = np.uint16(0xFFFF)
MISS = 1e-6
#: Nodes and shingles of a group that one task compares at once.
FAMILY, SHINGLES = 128, 2_000_000
#: Nodes of a large family with which all its chunks are compared.
HEADS = 16
#: Heads whose shingles need not be counted.
SHARED = 4
#: Rows up to this number (some 40 MB) are broadcast to find their sketches and texts; beyond, these are shuffled.
MOST_BROADCAST = 1_000_000

_EDGES = np.array([-(-b * (1 << 64) // BUCKETS) for b in range(BUCKETS)], dtype=np.uint64)
_WIDTH = float(1 << 64) / BUCKETS
_ORDER = np.argsort(np.random.default_rng(4).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.uint16)
_BAND = np.random.default_rng(5).integers(1, 1 << 63, size=BUCKETS, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = memo.of(words)
    n = max(len(hashes) - size + 1, 1)
    width = min(size, len(hashes))
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    return np.unique(total)


def registers(values: np.ndarray) -> np.ndarray:
    """BUCKETS registers of a sorted, non-empty set; EMPTY where a bucket holds nothing."""
    first = np.searchsorted(values, _EDGES)
    held = np.minimum(first, len(values) - 1)
    low = values[held]
    filled = (first < len(values)) & (low >= _EDGES)
    filled[:-1] &= low[:-1] < _EDGES[1:]
    share = (low - _EDGES).astype(np.float64) / _WIDTH
    mantissa, exponent = np.frexp(np.maximum(share, 2.0**-62))
    out = (np.minimum(-exponent, 62).astype(np.uint16) << MANTISSA) | ((2 * mantissa - 1) * (1 << MANTISSA)).astype(np.uint16)
    out[~filled] = EMPTY
    return out


def borrowed(own: np.ndarray) -> np.ndarray:
    """The registers with the empty ones filled from others, chosen by the bucket alone."""
    empty = np.flatnonzero(own == EMPTY)
    if len(empty):
        donors = np.flatnonzero(own != EMPTY)
        own = own.copy()
        own[empty] = own[donors[_ORDER[np.ix_(empty, donors)].argmin(axis=1)]]
    return own


def rows_per_band(similarity: float) -> int:
    """The most rows per band with which a pair at the threshold is missed less often than MISS."""
    for rows in (12, 8, 6, 4, 3, 2):
        if (1 - similarity**rows) ** (BUCKETS // rows) < MISS:
            return rows
    return 1


def bands(own: np.ndarray, rows: int) -> np.ndarray:
    keys = (borrowed(own).astype(np.uint64) * _BAND).reshape(-1, rows).sum(axis=1, dtype=np.uint64)
    return mixed(keys + np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def compared(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of rows of registers: Jaccard estimates, corrected for chance collisions, and registers used."""
    empty = own == EMPTY
    same = np.stack([((own == row) & ~no).sum(axis=1) for row, no in zip(own, empty, strict=True)]).astype(np.float64)
    used = BUCKETS - empty.astype(np.float32) @ empty.astype(np.float32).T
    ratio = np.minimum.outer(sizes, sizes) / np.maximum.outer(sizes, sizes)
    chance = 0.1699 * used / (1 << MANTISSA) * 4 * ratio / np.square(1 + ratio)
    return (same - chance) / (used - chance), used


def estimates(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return compared(own, sizes)[0]


def possible(own: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be links: by their sizes, and by estimates that a link shows with a probability of MISS or more."""
    least = percent / 100
    guess, used = compared(own, sizes)
    low = np.clip(guess, 1e-9, least)
    away = low * np.log(low / least) + (1 - low) * np.log((1 - low) / (1 - least)) if least < 1 else np.where(low < 1, np.inf, 0)
    out = used * away <= 1 - np.log(MISS)
    out &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(out, False)
    return out


def intersections(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first ``rows`` sets with all sets."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    column = np.cumsum(counts > 1)[number[shared]] - 1
    owners = owners[shared]
    out = np.zeros((rows, len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owners[a:b], column[a:b] - begin] = 1
        out += part[:rows] @ part.T
    return out.astype(np.int64)


def linked_pairs(sets: list[np.ndarray], own: np.ndarray | None, percent: int, rows: int) -> np.ndarray:
    """(i, j) with i < ``rows`` of all pairs whose Jaccard similarity is at least ``percent`` hundredths.

    ``own``: the registers, if pairs are to be estimated before.
    """
    sizes = np.array([len(s) for s in sets])
    if own is not None:
        may = possible(own, sizes, percent)
    else:
        may = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        np.fill_diagonal(may, False)
    may[rows:, rows:] = False
    used = np.flatnonzero(may.any(axis=1))
    if not len(used):
        return np.zeros((0, 2), dtype=np.int64)
    left = int((used < rows).sum())
    common = intersections([sets[i] for i in used], left)
    union = sizes[used][:left, None] + sizes[used][None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & may[np.ix_(used[:left], used)])
    return np.stack([used[i], used[j]], axis=1)


def forest(nodes: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """For every node of a pair that is not its component's smallest: (node, smallest)."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            if nodes[a] > nodes[b]:
                a, b = b, a
            parent[b] = a
    return [(int(nodes[x]), int(nodes[root(x)])) for x in range(len(nodes)) if nodes[root(x)] != nodes[x]]


def _sketcher(size: int, rows: int):
    def run(batches):
        memo = WordHashes()
        for batch, texts in chunks(batches):
            counts, seals, keys, held = [], [], [], []
            for text in texts:
                values = shingle_set(text, size, memo)
                own = registers(values) if len(values) else None
                counts.append(len(values))
                seals.append(None if own is None else xxhash.xxh3_128_digest(values.tobytes()))
                keys.append(np.zeros(0, dtype=np.int64) if own is None else bands(own, rows))
                held.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(counts, pa.int64()),
                    pa.array(seals, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(held, pa.binary()),
                ],
                ["doc_id", "mark", "n_shingles", "seal", "bands", "registers"],
            )

    return run


def _register_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=np.uint16) for x in column.to_pylist()])


def _estimator(percent: int):
    """A small family by its registers to the parts that links can join; nodes without any such pair go."""

    def run(group: pa.Table) -> pa.Table:
        nodes, sizes = group.column("node").to_numpy(), group.column("n_shingles").to_numpy()
        pairs = np.argwhere(np.triu(possible(_register_rows(group.column("registers")), sizes, percent)))
        parts = forest(nodes, pairs)
        parts += [(b, b) for b in {b for _, b in parts}]
        return pa.table(
            {"family": pa.array([b for _, b in parts], pa.int64()), "node": pa.array([a for a, _ in parts], pa.int64())}
        )

    return run


SETS = "family long, chunk int, node long, registers binary, shingles array<long>"


def _setter(size: int):
    def run(batches):
        memo = WordHashes()
        for batch, texts in chunks(batches):
            sets = [shingle_set(t, size, memo) for t in texts]
            keep = ["family", "chunk", "node"]
            # only large families estimate pairs again; registers follow from the set
            large = [c >= 0 for c in batch.column("chunk").to_pylist()]
            own = [registers(s).tobytes() if big and len(s) else None for s, big in zip(sets, large, strict=True)]
            rest = [pa.array(own, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *rest], [*keep, "registers", "shingles"])

    return run


def _linker(percent: int):
    """A spanning forest of a group's links, estimated before where the rows have registers.

    With a column ``outside`` only links of the nodes where it is true are looked for.
    """

    def run(group: pa.Table) -> pa.Table:
        if "outside" in group.column_names:
            group = group.sort_by([("outside", "descending")])
        group = group.combine_chunks()
        nodes = group.column("node").to_numpy()
        column = group.column("shingles").combine_chunks()
        flat, cuts = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
        sets = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = int(group.column("outside").to_numpy().sum()) if "outside" in group.column_names else len(sets)
        own = _register_rows(group.column("registers")) if "registers" in group.column_names else None
        edges = forest(nodes, linked_pairs(sets, own, percent, rows))
        return pa.table(
            {"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())}
        )

    return run


EDGES = "a long, b long"


def _bounded(rows: DataFrame) -> DataFrame:
    """``rows`` as the broadcast side of a join, if they are few."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def _parts(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(FAMILY)), F.ceil(shingles / F.lit(SHINGLES))).cast("int")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(4)), parts).cast("int")


def _able(large: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Nodes of large families without those whose shingles that no other member has already rule out any link.

    Such shingles cannot be in an intersection, so this is exact.  Shingles of
    some heads are known to be shared; only the others are counted one by one.
    """
    some = large.join(heads.where(F.col("place") <= SHARED), ["family", "node"], "left_semi")
    held = some.groupBy("family").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("held"))
    rest = large.join(materialise(held, "held"), "family", "left")
    rest = rest.join(some.select("node"), "node", "left_anti").select(
        "family", "node", F.explode(F.array_except("shingles", F.coalesce("held", F.array().cast("array<long>")))).alias("shingle")
    )
    single = rest.groupBy("family", "shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = materialise(single.groupBy("node").agg(F.count("*").alias("alone")), "alone")
    own = F.size("shingles")
    able = large.join(alone, "node", "left").where(100 * (own - F.coalesce("alone", F.lit(0))) >= percent * own)
    return able.select(*large.columns)


def _large_links(large: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join what is linked in large families: ``large`` (SETS)."""
    link = _linker(percent)
    own = F.size("shingles")
    order = Window.partitionBy("family").orderBy(F.xxhash64("node"))
    fit = large.where(own <= SHINGLES // HEADS).select("family", "node")
    heads = fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEADS)
    heads = materialise(heads, "heads")
    able = large.join(materialise(_able(large, heads, percent).select("family", "node"), "able"), ["family", "node"], "left_semi")
    families = able.groupBy("family").agg(_parts(F.count("*"), F.sum(own)).alias("parts"))
    families = materialise(families, "parts")
    able = able.drop("chunk").join(families, "family").withColumn("chunk", _dealt(F.col("parts"))).select(*large.columns)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    copies = able.join(heads, ["family", "node"], "left_semi").join(families, "family").withColumn("to", every("parts"))
    rows = able.unionByName(copies.where("to <> chunk").withColumn("chunk", F.col("to")).select(*large.columns))
    near = materialise(rows.groupBy("family", "chunk").applyInArrow(link, EDGES), "chunk-links")

    found = components(near)
    placed = able.select("family", "node").join(found, "node", "left")
    placed = placed.select("family", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    outside = placed.join(main, "family").where("component <> main").select("family", "node")
    outside = materialise(outside.join(heads.select("node"), "node", "left_anti"), "outside")
    if outside.isEmpty():
        return near
    asked = able.join(outside, ["family", "node"], "left_semi")
    blocks = asked.groupBy("family").agg(_parts(F.count("*"), F.sum(own)).alias("blocks"))
    blocks = materialise(blocks.join(families, "family"), "blocks")
    columns = ["family", "block", "chunk", "node", "registers", "shingles"]
    mine = _dealt(F.col("blocks"))
    ask = asked.drop("chunk").join(blocks, "family").withColumn("block", mine).withColumn("chunk", every("parts"))
    # all that is no member of the block itself meets it, chunk by chunk
    meet = able.join(outside.withColumn("out", F.lit(True)), ["family", "node"], "left").join(blocks, "family")
    meet = meet.withColumn("block", every("blocks")).where(F.col("out").isNull() | (F.col("block") != mine))
    both = ask.select(*columns, F.lit(True).alias("outside")).unionByName(meet.select(*columns, F.lit(False).alias("outside")))
    return near.unionByName(both.groupBy("family", "block", "chunk").applyInArrow(link, EDGES))


def _links(members: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: links that join what is linked in each family of ``members`` (family, node, n_shingles, doc_id, mark, registers)."""
    families = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    small = (F.col("n") <= FAMILY) & (F.col("shingles") <= SHINGLES)
    families = materialise(families.select("family", small.alias("small")), "families")
    sized = members.join(families, "family")
    suspects = materialise(
        sized.where("small")
        .select("family", "node", "n_shingles", "registers")
        .groupBy("family")
        .applyInArrow(_estimator(percent), "family long, node long"),
        "suspects",
    )
    own = ["family", "chunk", "node", "doc_id", "mark"]
    few = members.drop("family").join(suspects, "node").withColumn("chunk", F.lit(-1)).select(*own)
    wanted = few.unionByName(sized.where("not small").withColumn("chunk", F.lit(0)).select(*own))
    wanted = materialise(wanted, "wanted")
    texts = docs.withColumnRenamed("doc_id", "of").withColumn("at", F.xxhash64("text"))
    same = texts["of"].eqNullSafe(wanted["doc_id"]) & (texts["at"] == wanted["mark"])
    found = texts.join(_bounded(wanted), same).select("family", "chunk", "node", "text")
    sets = materialise(found.mapInArrow(_setter(shingle), SETS), "sets")
    if sets.count() > wanted.count():  # rows repeated with their id and text
        sets = materialise(sets.dropDuplicates(["node"]), "sets")
    links = sets.where("chunk < 0").drop("registers").groupBy("family").applyInArrow(_linker(percent), EDGES)
    if families.where("not small").isEmpty():
        return links
    return links.unionByName(_large_links(sets.where("chunk >= 0"), percent))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id: long, text).

    Documents are linked whose sets of ``shingle``-word shingles have a Jaccard
    similarity of at least ``percent`` hundredths.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows_per_band(percent / 100)
    sketched = docs.withColumn("mark", F.xxhash64("text")).mapInArrow(
        _sketcher(shingle, rows),
        "doc_id long, mark long, n_shingles long, seal binary, bands array<long>, registers binary",
    )
    sketched = materialise(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = materialise(
        sketched.where(F.col("seal").isNotNull()).groupBy("seal").agg(F.min("row").alias("node"), F.min("doc_id").alias("id")),
        "nodes",
    )
    # sketches are as many as rows, so this join is never a broadcast's
    heads = nodes.select("node").hint("merge")
    first = sketched.select(F.col("row").alias("node"), "bands").join(heads, "node", "left_semi")
    keys = first.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = materialise(shared.where("least < most").select("key", "least"), "bands")
    met = keys.join(shared, "key").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    placed = whole(components(met.distinct())).withColumnRenamed("root", "family")
    of_row = sketched.select(F.col("row").alias("node"), "doc_id", "mark", "n_shingles", "registers")
    members = materialise(of_row.join(_bounded(placed), "node"), "members")

    rows_of = sketched.select("doc_id", "n_shingles", "seal").join(nodes, "seal", "left")
    rows_of = materialise(rows_of.drop("seal"), "rows")
    by_id = rows_of.where("doc_id is not null and node is not null").groupBy("doc_id")
    several = by_id.agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("doc_id", "b")
    same_id = rows_of.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a > b").distinct()
    joined = whole(components(_links(members, docs, shingle, percent).unionByName(same_id)))
    ids = joined.join(nodes.select("node", "id"), "node")
    least = ids.groupBy("root").agg(F.min("id").alias("least"))
    # apart from other steps, so that a hot node's rows can be dealt to tasks
    reach = materialise(joined.join(least, "root").select("node", "least", F.lit(True).alias("found")), "least")
    out = rows_of.join(reach, "node", "left")
    reached = F.when(F.col("found"), F.col("least")).when(F.col("node").isNotNull(), F.col("id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", reached.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def whole(found: DataFrame) -> DataFrame:
    """node, root of all nodes of ``components``, the roots included."""
    roots = found.select(F.col("component").alias("node"), F.col("component").alias("root")).distinct()
    return found.select("node", F.col("component").alias("root")).unionByName(roots)
