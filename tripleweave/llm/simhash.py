"""SimHash near-dedup: exact comparison, tile by tile, of 64-bit fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .base import arrow_bounds, cut, hinted, per_text, uncut
from .components import components
from .exact import kept_rows

#: Rows of a tile; a bucket of more rows is dealt out by pairs of tiles.
TILE = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The majority of each bit over the XXH64 hashes (seed 42) of the shingles of a text's words, A-Z in lower case.
    Text without words has 0; fewer words than a shingle are one shingle."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[len(words) - n :].tolist()
    hashes = np.fromiter((xxh64_intdigest(body[i:j], 42) for i, j in zip(starts, stops)), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)]) if n > 64 else np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; null text has no words."""

    def work(texts: list[bytes]) -> list[np.ndarray]:
        return [np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts)).view(np.int64)]

    return per_text(df, work, [T.StructField("fp", T.LongType())], id_col, text_col)


def linked(values: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect all of the distinct values within radius of each other: rows are sorted by
    population count and compared tile by tile; a tile whose counts begin beyond the radius ends its row of pairs."""
    bits = np.bitwise_count(values)
    order = np.argsort(bits, kind="stable")
    values, bits = values[order], bits[order].astype(np.int64)
    n = len(values)
    forest = Forest(n)

    for a in range(0, n, tile):
        left, most = values[a : a + tile], bits[min(a + tile, n) - 1]
        for b in range(a, n, tile):
            if bits[b] - most > radius:
                break
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ values[None, b : b + tile]) <= radius)
            i, j = i + a, j + b
            forest.join(i[i < j], j[i < j])
    member = np.nonzero(forest.root != np.arange(n))[0]
    return values[member], values[forest.root[member]]


#: Fingerprints that a bucket may hold on average before keys of more bits are taken.
CROWD = 16


def block_keys(radius: int, blocks: int) -> Column:
    """An array of (band, block): each choice of all but radius of a fingerprint's blocks is a band. Two values that differ
    in at most radius bits differ in at most radius blocks, and so agree on one of them whole."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for band, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for k in chosen:
            value = F.shiftleft(value, part[k][1]).bitwiseOR(part[k][0])
        keys.append(F.struct(F.lit(band).alias("band"), value.alias("block")))
    return F.array(*keys)


def blocks_for(rows: int, radius: int) -> int:
    """How many blocks, so that keys have bits enough for buckets of CROWD of so many values."""
    blocks = radius + 1
    while blocks < 16 and rows >> 64 * (blocks - radius) // blocks > CROWD:
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int = 2, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints (column fp) within radius bits, directly or over others.

    Two values at most radius bits apart agree on all but radius of their blocks, so only rows of one bucket are compared. There
    are radius + 1 blocks, or more for tables so large that buckets of their bits would fill: keys grow longer with the
    table, and what is compared grows with its rows and not with their square. A bucket of over `tile` rows falls into
    tiles by population count and hash; a pair of tiles is a task's work of its own, and pairs whose counts differ beyond
    the radius are never made. Within a task numpy compares by exclusive-or and bit counts, and gives a forest, never
    all pairs.
    """
    arrow_bounds(prints.sparkSession)
    blocks = blocks or blocks_for(prints.count(), radius)
    rows = prints.select("fp", F.bit_count("fp").alias("bits"), F.explode(block_keys(radius, blocks)).alias("key")).select("fp", "bits", "key.*")
    large = cut(rows.groupBy("band", "block", "bits").agg(F.count("*").alias("n")).groupBy("band", "block").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where(F.col("n") > tile))
    placed = rows.join(hinted(large), ["band", "block"], "left")
    cells = F.ceil(F.col("most") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    pairs = F.flatten(F.transform(F.array(*[F.lit(d) for d in range(-radius, radius + 1)]), lambda d: F.transform(every, lambda c: F.when(d < 0, F.struct((F.col("bits") + d).alias("p"), c.alias("c"), F.col("bits").alias("q"), F.col("own").alias("e"))).when((d == 0) & (c < F.col("own")), F.struct(F.col("bits").alias("p"), c.alias("c"), F.col("bits").alias("q"), F.col("own").alias("e"))).otherwise(F.struct(F.col("bits").alias("p"), F.col("own").alias("c"), (F.col("bits") + d).alias("q"), c.alias("e"))))))
    split = placed.where("n is not null").withColumn("cells", cells).withColumn("own", own).select("fp", "band", "block", F.explode(pairs).alias("pair")).select("fp", F.xxhash64("band", "block", "pair.p", "pair.c", "pair.q", "pair.e").alias("task"))
    whole = placed.where("n is null").select("fp", F.xxhash64("band", "block").alias("task"))
    tasks = whole.unionByName(split) if not large.isEmpty() else whole
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tasks: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.nonzero(np.diff(tasks))[0] + 1, [len(tasks)]])
            members, roots = [], []
            for k in np.nonzero(np.diff(starts) > 1)[0]:
                m, r = linked(np.unique(values[starts[k] : starts[k + 1]]), radius)
                members.append(m), roots.append(r)
            a, b = (np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64) for x in (members, roots))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        tasks, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            tasks = np.concatenate([tasks, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(tasks, tasks[-1]) if len(tasks) else 0  # the last task may go on in the next batch
            if last:
                yield found(tasks[:last], values[:last])
                tasks, values = tasks[last:], values[last:]
        if len(tasks):
            yield found(tasks, values)

    return tasks.repartition("task").sortWithinPartitions("task").select("task", "fp").mapInArrow(compare, out)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, fingerprint_rows), one row for each row of df.

    Rows whose fingerprints differ in at most radius bits are linked; component_id is the smallest id reachable over
    links, the row's own included, null only where no row of the component has an id. Equal fingerprints, however many,
    are one node. Null and empty texts have fingerprint zero and are linked like others; repeated rows keep their rows;
    an empty table gives an empty table; other columns are neither read nor returned.
    """
    prints = cut(fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "id"))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    roots = hinted(cut(components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")))
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    least = hinted(cut(rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))))
    classes = hinted(cut(rooted.join(least, "root", "left").select("fp", "rows", F.coalesce("least", "first").alias("component_id"))))
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("rows").alias("fingerprint_rows"))


#: Bits, words of a shingle and radius by which candidates are compared: at a similarity of 0.8 fingerprints of 256 bits
#: differ in 39 bits, give or take 6; those of unrelated texts in 128, give or take 8.
WIDE, WIDE_SHINGLE, WIDE_RADIUS = 256, 5, 72
#: Texts meet in a bucket of a band: ROWS least hashes that they share. At a similarity of 0.8 one of BANDS bands is
#: shared with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, which is 0.9992; at 0.3 with 0.04.
BANDS, ROWS = 18, 5
#: Pairs in which a text has at most so many shingles meet by shared least shingles, which misses none.
SHORT = 32
#: A bucket of more rows names its rows candidates of its first without comparing fingerprints.
BUCKET = 4096
#: Rows and shingles of one side of a task of exact comparison.
SETS, SET_SHINGLES = 512, 1 << 20
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS = np.random.default_rng(43).integers(0, 1 << 63, WIDE_SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles (fewer words than a shingle are one), made of its words'
    hashes by a sum with an odd factor for each place."""
    from xxhash import xxh3_64_intdigest

    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    factors = np.random.default_rng(43).integers(0, 1 << 63, shingle, np.uint64) * np.uint64(2) + np.uint64(1) if shingle != WIDE_SHINGLE else _FACTORS
    n = min(shingle, len(each))
    total = np.full(len(each) - n + 1, np.uint64(n))
    for k in range(n):
        total += each[k : len(each) - n + 1 + k] * factors[k]
    keys = np.sort(mixed(total))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def wide_fingerprint(raw: bytes, shingle: int = WIDE_SHINGLE, part: int = 255) -> tuple[bytes, np.ndarray]:
    """256 majority bits over four 64-bit hashes of each distinct shingle, and the sorted 64-bit hashes of the distinct
    shingles (none without words)."""
    words = raw.lower().split()
    if not words:
        return bytes(WIDE // 8), np.empty(0, np.uint64)
    keys = shingle_hashes(words, shingle)
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(keys), part):
        lanes = mixed(keys[at : at + part, None] + _GOLDEN * np.arange(1, WIDE // 64 + 1, dtype=np.uint64))
        counts += np.add.reduce(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)  # up to 255 fit
    return np.packbits(counts * 2 > len(keys), bitorder="little").tobytes(), keys


def near_pairs(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs within radius bits (rows of four 64-bit lanes) whose sizes allow the similarity. Three lanes are
    counted for all pairs, the last only where these are within the radius."""
    near = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    near += np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    near += np.bitwise_count(left[:, None, 2] ^ right[None, :, 2])
    i, j = np.nonzero(near <= radius)
    if len(i):
        some = near[i, j].astype(np.int64) + np.bitwise_count(left[i, 3:] ^ right[j, 3:]).sum(axis=1) <= radius
        i, j = i[some], j[some]
        alike = np.minimum(left_sizes[i], right_sizes[j]) >= similarity * np.maximum(left_sizes[i], right_sizes[j]) - 1e-9
        i, j = i[alike], j[alike]
    return i, j


class Forest:
    """Union by least index over arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                return
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def band_keys(shingles: np.ndarray, part: int = 4096) -> list[int]:
    """A key for each band: the hash of ROWS minima of permuted shingle hashes. Odd, as signed longs."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), part):
        np.minimum(least, (shingles[None, at : at + part] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    body = least.tobytes()
    keys = [xxh64_intdigest(body[8 * ROWS * k : 8 * ROWS * (k + 1)], k) | 1 for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def short_keys(shingles: np.ndarray, similarity: float) -> list[int]:
    """Keys of which texts with such similar sets share one: sets of n shingles share one of the n - ceil(similarity x n)
    + 1 least of each, and their sizes are of one class of that ratio, or of two in turn. Even, as signed longs."""
    from xxhash import xxh64_intdigest

    n = len(shingles)
    least = shingles[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
    c = int(np.floor(np.log(n) / -np.log(similarity) + 1e-9))
    keys = [xxh64_intdigest(x.tobytes(), k) & ~1 for x in least for k in (c, c + 1)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def candidates(nodes: DataFrame, radius: int = WIDE_RADIUS, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges between rows of nodes (columns row, node: bytes that begin with the fingerprint, size, keys) that
    connect all that share a bucket and may be similar.

    Only rows that share a key with another meet, so the work grows with the copies and not with the square of the table.
    In a bucket of a band, rows are sorted by population count and their fingerprints compared tile by tile; tile pairs
    whose counts differ beyond the radius are skipped, and a forest is returned, never all pairs. Fingerprints of short
    texts tell little, and a bucket of over `bucket` rows is too large for one task: there each row is linked to the
    bucket's first, and the exact comparison, which works in cells, has the word.
    """
    arrow_bounds(nodes.sparkSession)
    keyed = nodes.select("row", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("row").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    met = cut(keyed.join(hinted(shared), "key"))
    plain = (F.col("n") > bucket) | (F.col("key").bitwiseAND(F.lit(1)) == 0)
    direct = met.where(plain & (F.col("row") != F.col("lead"))).select(F.col("row").alias("a"), F.col("lead").alias("b"))
    compared = met.where(~plain).join(nodes.select("row", "node", "size"), "row").select("key", "row", "node", "size")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            rows, sizes = table.column("row").to_numpy(), table.column("size").to_numpy()
            lanes = np.frombuffer(b"".join(table.column("node").to_pylist()), np.uint64).reshape(len(rows), -1)[:, : WIDE // 64]
            bits = np.bitwise_count(lanes).sum(axis=1).astype(np.int64)
            order = np.argsort(bits, kind="stable")
            forest, tile = Forest(len(rows)), 512
            for at in range(0, len(order), tile):
                a = order[at : at + tile]
                for to in range(at, len(order), tile):
                    b = order[to : to + tile]
                    if bits[b[0]] - bits[a[-1]] > radius:
                        break
                    i, j = near_pairs(lanes[a], lanes[b], sizes[a], sizes[b], radius, similarity)
                    forest.join(a[i], b[j])
            member = np.nonzero(forest.root != np.arange(len(rows)))[0]
            return rows[member], rows[forest.root[member]]

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column("key").to_numpy()
            ends = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]]) if len(keys) else []
            a, b = [], []
            for lo, hi in zip(ends, ends[1:]):
                if held and held[-1].column("key")[0].as_py() != keys[lo]:
                    for kept, more in zip((a, b), found(pa.concat_tables(held))):
                        kept.append(more)
                    held = []
                held.append(table.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.empty(0, np.int64)])) for x in (a, b)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(pa.concat_tables(held))], names=["a", "b"])

    return compared.repartition("key").sortWithinPartitions("key").mapInArrow(compare, out).unionByName(direct)


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the sets the place of the first one that pairs of the similarity (shared by all) or more lead to.
    From each set reached, only sets not yet reached are compared, and of these only the sizes that allow it."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    root, left = np.arange(len(sets)), np.argsort(sizes, kind="stable")
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), bool)
    while len(left):
        reached, left = [left[0]], left[1:]
        group = list(reached)
        while reached and len(left):
            at = reached.pop()
            size, known = sizes[at], sizes[left]
            lo, hi = np.searchsorted(known, size * similarity - 1e-6), np.searchsorted(known, size / similarity + 1e-6, "right")
            some = left[lo:hi]
            if not len(some):
                continue
            own, many = codes[starts[at] : starts[at] + size], sizes[some]
            ends = np.cumsum(many)
            mark[own] = True
            shared = np.add.reduceat(mark[codes[np.repeat(starts[some] - ends + many, many) + np.arange(ends[-1])]], ends - many, dtype=np.int64)
            mark[own] = False
            hit = shared >= similarity * (size + many - shared) - 1e-9
            reached += some[hit].tolist()
            group += some[hit].tolist()
            left = np.concatenate([left[:lo], some[~hit], left[hi:]])
        root[group] = min(group)
    return root


def _compared(tasks: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges that connect the similar sets of each task (columns task, row, shingles)."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[int], bodies: list[bytes]) -> tuple[list[int], list[int]]:
            root = similar([np.frombuffer(x, np.uint64) for x in bodies], similarity)
            member = np.nonzero(root != np.arange(len(root)))[0]
            return [rows[k] for k in member], [rows[k] for k in root[member]]

        task, rows, bodies = None, [], []
        for batch in batches:
            a, b = [], []
            for t, row, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if t != task and len(rows) > 1:
                    for held, more in zip((a, b), found(rows, bodies)):
                        held += more
                if t != task:
                    task, rows, bodies = t, [], []
                rows.append(row), bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found(rows, bodies)], names=["a", "b"])

    arrow_bounds(tasks.sparkSession)
    return tasks.select("task", "row", "shingles").repartition("task").sortWithinPartitions("task").mapInArrow(compare, out).where("a <> b")


def confirmed(sets: DataFrame, similarity: float = 0.8, rows: int = SETS, shingles: int = SET_SHINGLES) -> DataFrame:
    """(a, b): edges that connect all rows (columns root: group of candidates, row, size, shingles: sorted hashes as
    bytes) of a group whose sets are similar, computed exactly.

    A group is one task. A larger one is cut in cells of about so many rows or shingles. First each cell is compared by
    itself and with the group's first row, which joins all copies of one text over all cells. Only rows that still are
    apart from the first row then meet every cell of their group, so that a group of near copies costs in proportion to
    its rows, however many they are, and no pair is left out.
    """
    cells = F.ceil(F.greatest(F.count("*") / F.lit(rows), F.sum("size") / F.lit(shingles))).cast("int")
    large = hinted(cut(sets.groupBy("root").agg(cells.alias("k"), F.min("row").alias("lead")).where("k > 1")))
    alone = cut(_compared(sets.join(large.select("root"), "root", "left_anti").withColumn("task", F.col("root")), similarity))
    if large.isEmpty():
        return alone
    whole = cut(sets.join(large, "root"))
    cell = lambda n, mark: F.pmod(F.xxhash64("row", F.lit(mark)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = whole.select(F.xxhash64("root", cell(F.col("k"), 0)).alias("task"), "row", "shingles")
    first = whole.where("row = lead").select("root", "row", "shingles", upto(F.col("k")).alias("cell")).select(F.xxhash64("root", "cell").alias("task"), "row", "shingles")
    around = cut(_compared(own.unionByName(first), similarity))
    ends = hinted(cut(components(around).select("node", F.col("root").alias("end"))))
    led = hinted(cut(large.join(ends, F.col("lead") == F.col("node"), "left").select("root", F.coalesce("end", "lead").alias("led"))))
    apart = cut(whole.join(ends, F.col("row") == F.col("node"), "left").join(led, "root").where("coalesce(end, row) <> led").select(*whole.columns))
    found = alone.unionByName(around)
    if apart.isEmpty():
        return found
    few = cut(apart.groupBy("root").agg(cells.alias("m"), F.max("k").alias("k")))
    grid = hinted(few.drop("k"))
    pair = F.xxhash64("root", "x", "y").alias("task")
    rest = apart.join(grid, "root").select("root", "row", "shingles", cell(F.col("m"), 1).alias("x"), upto(F.col("k")).alias("y"))
    others = whole.join(grid, "root").select("root", "row", "shingles", cell(F.col("k"), 0).alias("y"), upto(F.col("m")).alias("x"))
    return found.unionByName(_compared(rest.select(pair, "row", "shingles").unionByName(others.select(pair, "row", "shingles")), similarity))


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _classes(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, digest: MD5 of the text, node) of each row, and (node, component_id, keeper, rows) of each different set of
    shingles: keeper is the (without id, id, digest) of the class's row that comes first."""
    from xxhash import xxh3_64_digest

    both = int(SHORT / similarity + 1e-9)
    named = lambda f, s: f + xxh3_64_digest(s.tobytes())

    def work(texts: list[bytes]) -> list[list]:
        digests, nodes, sizes, keys = [], [], [], []
        for x in texts:
            f, s = wide_fingerprint(x, shingle)
            digests.append(hashlib.md5(x).digest()), nodes.append(named(f, s)), sizes.append(len(s))
            keys.append((band_keys(s) if len(s) > SHORT else []) + (short_keys(s, similarity) if 0 < len(s) <= both else []))
        return [digests, nodes, sizes, keys]

    def again(texts: list[bytes]) -> list[list]:
        found = [wide_fingerprint(x, shingle) for x in texts]
        return [[named(*x) for x in found], [len(s) for _, s in found], [s.tobytes() for _, s in found]]

    node, size = T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType())
    prints = cut(per_text(df, work, [T.StructField("digest", T.BinaryType()), node, size, T.StructField("keys", T.ArrayType(T.LongType()))], id_col, text_col).withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest")).alias("first")
    nodes = cut(prints.groupBy("node", "size").agg(first, F.min("row").alias("row"), F.count("*").alias("rows"), F.first("keys").alias("keys")))
    groups = cut(components(candidates(nodes, radius, similarity)))
    chosen = cut(nodes.join(hinted(groups.select(F.col("node").alias("row"), "root")), "row").select("node", "row", "root", "first.id", "first.digest"))
    # sets are made again for candidates alone, so that none is kept of the many texts that are like no other
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_digest(text_col).alias("digest"))
    wanted = hinted(cut(chosen.select(F.col("id").alias("its"), F.col("digest").alias("own"))))
    some = texts.join(wanted, F.col("id").eqNullSafe(F.col("its")) & (F.col("digest") == F.col("own")), "left_semi")
    made = per_text(some, again, [node, size, T.StructField("shingles", T.BinaryType())], "id", "text")
    sets = cut(made.join(hinted(chosen.select("node", "row", "root")), "node").select("root", "row", "size", "shingles"))
    roots = cut(components(confirmed(sets, similarity)))
    uncut(sets)
    rooted = nodes.join(hinted(roots.select(F.col("node").alias("row"), "root")), "row", "left").select("node", "first", "rows", F.coalesce("root", "row").alias("root"))
    rooted = cut(rooted)
    crowded = hinted(cut(rooted.join(hinted(cut(roots.select("root").distinct())), "root", "left_semi").groupBy("root").agg(F.min("first").alias("keeper"), F.min("first.id").alias("least"), F.sum("rows").alias("many"))))
    joined = rooted.join(crowded, "root", "left")
    classes = joined.select("node", F.coalesce("least", "first.id").alias("component_id"), F.coalesce("keeper", "first").alias("keeper"), F.coalesce("many", "rows").alias("rows"))
    return prints.select("id", "digest", "node"), cut(classes)


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, similarity: float = 0.8) -> DataFrame:
    """(id, component_id), one row for each row of df: classes of texts that pairs of the similarity or more connect,
    by their sets of shingles of five words (repeats count once). Bands of least hashes, and shared least shingles of short
    texts, bring candidates together; wide fingerprints are compared among these; each link is confirmed on the sets (of
    64-bit hashes). Texts without words are one class. Other cases as in near_copies()."""
    prints, classes = _classes(df, id_col, text_col, shingle, radius, similarity)
    return prints.join(hinted(classes.select("node", "component_id")), "node").select(F.col("id").alias(id_col), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, similarity: float = 0.8) -> DataFrame:
    """df with one row of each class of near_texts(), all its columns as they are, whatever their names.

    The row with the smallest id stays, of rows that share it the one whose text has the smallest MD5, of rows that share
    both any one; a row without id stays only where its class has no other. Null, empty and blank texts are one class;
    texts of any length are compared whole; an empty table gives an empty table.
    """
    prints, classes = _classes(df, id_col, text_col, shingle, radius, similarity)
    crowded = hinted(cut(classes.where("rows > 1").select("node", "keeper")))
    stays = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("digest") == F.col("keeper.digest"))
    found = cut(prints.join(crowded, "node").groupBy("id", "digest").agg(F.max(stays).alias("stays"), F.count("*").alias("rows")))
    return kept_rows(df, found, id_col, text_digest(text_col))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
