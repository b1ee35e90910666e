"""SimHash near-duplicate groups: segment popcounts as an embedding, a grid range join on it, exact verification.

Two fingerprints whose Hamming distance is at most k have segment popcounts at most k apart in Manhattan distance. Segments
are two bits wide, and a popcount 0, 1 or 2 is kept in unary (00, 01, 11), so the whole embedding is one long and the Manhattan
distance of two embeddings is the bit count of their exclusive or. The segments are dealt to groups so that some group is at
most two apart; each point visits the grid cells within one step of its own in each group, so two such points meet in a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from perfloom.llm.common import fresh, ship, written

SEED = 42
_LOW = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256
#: Bands and least hashes per band: sets of Jaccard similarity j share a band with probability 1 - (1 - j ** DEPTH) ** BANDS.
BANDS, DEPTH = 32, 5
#: Bits of 128 in which pairs worth a comparison of sets differ at most; at a similarity of 0.8 the mean is 19, of sets of five 24.
LOOSE = 44
#: Sets, and elements of all of them, that one side of a comparison in a task holds at most (one greater set alone).
BLOCK_SETS, BLOCK_ELEMENTS = 4096, 2_000_000
#: Rows of cells that are compared in one go, or one cell if that has more.
BLOCK_VISITS = 200_000
#: Nodes that a task holds when it makes stars of its links.
STAR_NODES = 1_000_000
#: Points to compare are broadcast by their hash up to this number.
BROADCAST_POINTS = 1_000_000
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * DEPTH), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends, k = starts + size, min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist())], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    # Per byte column a histogram of byte values, then bits of byte values: counts of every bit.
    hist = np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits(((hist @ _BITS) * 2 > len(h)).ravel(), bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Second hashes of the same shingles."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned fingerprint of the shingles of ``width`` words; 0 for a text without words."""
    return fingerprint_pair(text, width)[0]


def fingerprint_pair(text: str | None, width: int, second: bool = False) -> tuple[int, int, int]:
    """The fingerprint, one of second hashes where wanted, and the number of shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z lowered, only ASCII white space splits
    if not words:
        return 0, 0, 0
    h = _hashes(words, width)
    return _majority(h), _majority(_mixed(h)) if second else 0, len(h)


def text_hash(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c, F.lit("")))


def fingerprints(docs: DataFrame, width: int = 4, second: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_hash, ``fp`` and ``fp2`` (fingerprints as signed longs) and ``size`` (shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint_pair(t.as_py(), width, second) for t in b.column(1)]
            fps = [pa.array(np.array([g[i] for g in got], dtype=np.uint64).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *fps, pa.array([g[2] for g in got], pa.int64())], ["id", "text_hash", "fp", "fp2", "size"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, fp long, fp2 long, size long")


def _hex_long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, in unary."""
    low, right = _hex_long(_LOW), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(right).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(right).bitwiseAND(low))


def cells(emb: Column, max_distance: int) -> Column:
    """Grid cells that a point visits: per group of segments its own cell and those one step away."""
    groups = max_distance // 3 + 1  # floor(max_distance / groups) is at most 2
    out = []
    for g in range(groups):
        segs = range(32 * g // groups, 32 * (g + 1) // groups)
        mask = sum(3 << (2 * s) for s in segs)
        own, tag = emb.bitwiseAND(_hex_long(mask)), F.lit(g)
        out.append(F.struct(tag.alias("g"), own.alias("cell")))
        for s in segs:
            lo, hi = _hex_long(1 << (2 * s)), _hex_long(2 << (2 * s))
            # 00 <-> 01 changes the low bit where the high one is clear, 01 <-> 11 the high bit where the low one is set.
            out.append(F.when(emb.bitwiseAND(hi) == 0, F.struct(tag.alias("g"), own.bitwiseXOR(lo).alias("cell"))))
            out.append(F.when(emb.bitwiseAND(lo) != 0, F.struct(tag.alias("g"), own.bitwiseXOR(hi).alias("cell"))))
    return F.array(*out)


def _visits(points: DataFrame, max_distance: int, name: str = "fp") -> DataFrame:
    """(fp, name, g, cell): the cells that each distinct fingerprint of column ``fp`` visits."""
    own = list(dict.fromkeys(("fp", name)))
    seen = points.select(*own, F.explode(cells(embedding(F.col("fp")), max_distance)).alias("c")).where(F.col("c").isNotNull())
    return seen.select(*own, F.col("c.g").alias("g"), F.col("c.cell").alias("cell"))


def _near_in_cells(max_distance: int, forest: bool, name: str = "fp"):
    """Pairs of near fingerprints that share a cell, or a forest of them, of rows sorted by cell, each by its ``name``.

    Row i is compared with row i + 1, i + 2 and so on as long as some cell reaches so far, each step for all rows of the whole cells
    at hand, so cells of two rows cost no call of their own and no more than a row for each comparison is held.
    """
    def near(fp: np.ndarray, names: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, step = np.arange(len(fp)), 1
        while len(i := i[i + step < end[i]]):
            hit = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_distance]
            if len(hit):
                yield names[hit], names[hit + step]
            step += 1

    def links_of(fp: np.ndarray, names: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(fp))
        end = np.repeat(cut, np.diff(cut, prepend=0))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for a, b in near(fp, names, end):
            if forest:
                kept = []
                for x, y in zip(a.tolist(), b.tolist()):
                    if (rx := top(x)) != (ry := top(y)):
                        parent[rx] = ry
                        kept.append((x, y))
                a, b = np.array(kept, dtype=np.uint64).reshape(-1, 2).T
            a, b = a.astype(np.int64), b.astype(np.int64)  # unsigned to signed, bit by bit
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, cell = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64)
        names = fp
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "g", "cell", name)]
            fp = np.concatenate((fp, new[0].view(np.uint64)))
            names = fp if name == "fp" else np.concatenate((names, new[3].view(np.uint64)))
            cell = np.concatenate((cell, np.stack((new[1].astype(np.int64), new[2]), axis=1)))
            if len(fp) < BLOCK_VISITS:
                continue
            number = np.append(0, np.cumsum((cell[1:] != cell[:-1]).any(axis=1)))
            whole = int(np.searchsorted(number, number[-1]))
            if whole:
                yield from links_of(fp[:whole], names[:whole], number[:whole])
                fp, names, cell = fp[whole:], names[whole:], cell[whole:]
        if len(fp):
            yield from links_of(fp, names, np.append(0, np.cumsum((cell[1:] != cell[:-1]).any(axis=1))))

    return run


def links(points: DataFrame, max_distance: int = 4, forest: bool = False, name: str = "fp") -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column ``fp`` that differ in at most ``max_distance`` bits; a and b are of column ``name``.

    With ``forest`` only those are given that join two groups of their task's cells: the components are the same, and a group of
    many near fingerprints gives no more links than it has visits.
    """
    ship(points.sparkSession)
    dealt = _visits(points, max_distance, name).repartition("g", "cell").sortWithinPartitions("g", "cell")
    return dealt.mapInArrow(_near_in_cells(max_distance, forest, name), "a long, b long").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups that a task's own links make, each as links (node, smallest node); beyond ``STAR_NODES`` nodes it begins anew."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (ra := top(a)) != (rb := top(b)):
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) >= STAR_NODES:
            yield from stars()
            parent.clear()
    yield from stars()


def _both(first: tuple[Column, Column], second: tuple[Column, Column], names: tuple[str, str]) -> Column:
    """Two rows of ``names`` out of each row."""
    return F.inline(F.array(*(F.struct(*(c.alias(n) for c, n in zip(row, names))) for row in (first, second))))


def _are_stars(edges: DataFrame) -> bool:
    """Whether all ``edges`` (a, b) of an a lead to one b, and no b is an a."""
    a, b = F.col("a"), F.col("b")
    ends = edges.select(_both((a, b), (b, F.lit(None).cast("long")), ("node", "to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count("to").alias("out"), F.count(F.lit(1)).alias("all"))
    return seen.where((F.col("low") != F.col("high")) | (F.col("out") > 0) & (F.col("out") < F.col("all"))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root the smallest node of its component.

    Each task first makes stars of its own links, and again after each round, so few rounds are left. Rounds are alternating
    large-star and small-star steps, each a minimum per node and a join, and end as soon as only stars are left. Each step is
    written to the shared folder, as long plans weigh on the driver, which gets one row per round.
    """
    shape, a, b, m = "a long, b long", F.col("a"), F.col("b"), F.col("m")
    edges = written(edges.mapInArrow(_stars, shape))  # a > b from here on
    while not _are_stars(edges):
        least = edges.select(_both((a, b), (b, a), ("u", "v"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(edges.join(least, b == F.col("u")).select("a", m.alias("b")))
        least = large.groupBy(a.alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, a == F.col("u")).select(_both((a, m), (b, m), ("a", "b")))
        edges = written(small.mapInArrow(_stars, shape))
    return edges.select(_both((a, b), (b, b), ("node", "root"))).distinct()


def _named(rows: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """Per row: id, text_hash, point, root (of its group), component_id; ``points`` has the least id of each point."""
    roots = components(edges)
    linked = points.join(roots, F.col("point") == F.col("node")).select("point", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only points with a link are looked up; all others are their own component.
    moved = linked.select("point", "root").join(of_root, "root").select("point", "root", "component_id")
    named = points.join(moved, "point", "left").select("point", F.coalesce("root", "point").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "point")


def near_duplicates(docs: DataFrame, width: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Fingerprints link at ``max_distance`` or fewer differing bits. Texts without words, null ones too, have fingerprint 0.
    Rows of one fingerprint are one point of the join. A null id takes part; its component's smallest id ignores it.
    """
    rows = written(fingerprints(docs, width, False, id_col, text_col).select("id", F.col("fp").alias("point")))
    points = rows.groupBy("point").agg(F.min("id").alias("least"))
    found = links(points.select(F.col("point").alias("fp")), max_distance, forest=True)
    return _named(rows, points, found).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def _forest(distance: int, both: int, ratio: float):
    """Links of rows that share a cell, of which only those are kept that join two groups, nearest first.

    Rows come sorted by cell and size. Each is compared with the rows before it in its cell whose size is at least ``ratio`` of
    its own; the window is all that is held. Distances are exact.
    """
    columns = ("g", "cell", "size", "fp", "fp2", "point")

    def joined(c: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        parent = list(range(len(c["fp"])))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = np.searchsorted(c["size"], np.ceil(c["size"] * ratio - 1e-9), side="left")
        for at in range(0, len(parent), 512):
            to = min(at + 512, len(parent))
            low = int(first[at])
            d = np.bitwise_count(c["fp"][at:to, None] ^ c["fp"][None, low:to])
            i, j = np.nonzero(d <= distance)
            i, j = i + at, j + low
            keep = (j < i) & (j >= first[i])
            i, j = i[keep], j[keep]
            d = np.bitwise_count(c["fp"][i] ^ c["fp"][j]) + np.bitwise_count(c["fp2"][i] ^ c["fp2"][j]).astype(np.int64)
            keep = np.flatnonzero(d <= both)
            keep = keep[np.argsort(d[keep], kind="stable")]
            for a, b in zip(i[keep].tolist(), j[keep].tolist()):
                ra, rb = top(a), top(b)
                if ra != rb:
                    parent[ra] = rb
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def finish(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = c["g"].astype(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (c["cell"][1:] != c["cell"][:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if hi - lo > 1:
                    part = {k: v[lo:hi] for k, v in c.items()}
                    for i, j in joined(part):
                        a.append(int(part["point"][i])), b.append(int(part["point"][j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in columns}
            new |= {n: new[n].view(np.uint64) for n in ("fp", "fp2")}
            if not batch.num_rows:
                continue
            held = new if held is None else {n: np.concatenate((held[n], new[n])) for n in new}
            last = (held["g"] != held["g"][-1]) | (held["cell"] != held["cell"][-1])
            end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if end:
                yield from finish({n: v[:end] for n, v in held.items()})
                held = {n: v[end:] for n, v in held.items()}
        if held is not None:
            yield from finish(held)

    return run


def similar_links(points: DataFrame, distance: int, both: int, ratio: float) -> DataFrame:
    """Links (a, b) of ``points`` (point, fp, fp2, size) that join all points of which the first fingerprints differ in at most
    ``distance`` bits, both together in at most ``both``, and the sizes by no more than ``ratio``."""
    emb = points.select("point", "fp", "fp2", "size", F.explode(cells(embedding(F.col("fp")), distance)).alias("c")).where(F.col("c").isNotNull())
    visits = emb.select("point", "fp", "fp2", "size", F.col("c.g").alias("g"), F.col("c.cell").alias("cell"))
    return visits.repartition("g", "cell").sortWithinPartitions("g", "cell", "size").mapInArrow(_forest(distance, both, ratio), "a long, b long")


def _sketch(text: str | None, width: int) -> tuple[int, int, int, int, np.ndarray]:
    """Of the text's set of shingles: a hash, two fingerprints, the number, and one key per band of least hashes."""
    h = shingle_set(text, width)
    if not len(h):
        return 0, 0, 0, 0, np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, DEPTH))]
    return xxhash.xxh64_intdigest(h.tobytes()), _majority(h), _majority(_mixed(h)), len(h), np.array(keys, dtype=np.uint64).view(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles of ``width`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(_hashes(words, width)) if words else np.zeros(0, dtype="<u8")


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, text_hash, ``point`` (hash of the set of shingles), ``fp``, ``fp2``, ``size`` (of the set) and band ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_sketch(t.as_py(), width) for t in b.column(1)]
            point, fp, fp2 = (pa.array(np.array([g[i] for g in got], dtype=np.uint64).view(np.int64)) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), point, fp, fp2, pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.list_(pa.int64()))],
                ["id", "text_hash", "point", "fp", "fp2", "size", "keys"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, point long, fp long, fp2 long, size long, keys array<long>")


def _candidates(points: DataFrame, ratio: float) -> DataFrame:
    """Links (a, b) of points that are near by the grid join of their fingerprints or share a band: a forest of each cell's.

    The grid join finds all within four bits; at a similarity of 0.8 fingerprints lie further apart, and bands find those.
    """
    same = written(points.groupBy("fp").agg(F.min("point").alias("one")))
    near = written(links(same, 4, forest=True, name="one"))
    equal = points.select("fp", "point").join(same.withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).where("point <> one").select(F.col("point").alias("a"), F.col("one").alias("b"))
    visits = points.select("point", "fp", "fp2", "size", F.posexplode("keys").alias("g", "cell"))
    found = visits.repartition("g", "cell").sortWithinPartitions("g", "cell", "size").mapInArrow(_forest(64, LOOSE, ratio), "a long, b long")
    return found.union(near).union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) of which the ``sets`` (node, s) have at least this Jaccard similarity."""
    first, second = (sets.select(F.col("node").alias(c + "_"), F.col("s").alias("s" + c)) for c in ("a", "b"))
    both = edges.join(first, F.col("a") == F.col("a_")).join(second, F.col("b") == F.col("b_"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def set_forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets, one of ``left`` and one of ``right``, of which only those are kept that join two groups.

    Shared elements are counted by the lists of sets that hold each element, so no pair is looked at twice. ``root`` names the
    groups to begin with.
    """
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    begin = np.concatenate(([0], np.cumsum(size)))
    held = right[owner]
    order = np.argsort(code[held], kind="stable")
    holder, first = owner[held][order], np.concatenate(([0], np.cumsum(np.bincount(code[held], minlength=int(code.max()) + 1))))
    group, out = np.unique(root, return_inverse=True)[1], []
    for i in np.flatnonzero(left).tolist():
        own = code[begin[i] : begin[i + 1]]
        shared = np.bincount(np.concatenate([holder[first[c] : first[c + 1]] for c in own.tolist()]), minlength=len(sets))
        near = (shared > 0) & (shared >= similarity * (size + size[i] - shared) - 1e-9) & (group != group[i])
        for j in np.flatnonzero(near).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def joined_sets(sets: DataFrame, similarity: float, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """Links (a, b) that join all similar sets of different groups: ``sets`` (node, s, root) fall into ``pool``, and similar sets share one.

    Within a pool the greatest group need not be compared with itself. All else is compared in blocks of bounded size: blocks of one
    band of set sizes and the next, as similar sets differ little in size. A task holds two blocks and gives back a forest.
    """
    size = F.size("s")
    # rounding must not part a size from one that is just similar
    band = F.floor(F.ln(F.greatest(size, F.lit(1)).cast("double")) / -math.log(similarity * 0.999)).cast("int")
    # Sets are dealt by tables without them, each written, so that no plan holds another twice.
    sized = sets.select("pool", "node", "root", size.alias("size"), band.alias("band"))
    groups = sized.groupBy("pool", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    pools = groups.groupBy("pool").agg(F.max(F.struct("n", "root"))["root"].alias("main_root"), F.sum("n").alias("all"), F.sum("elements").alias("all_elements"))
    small = (F.col("all") <= block_sets) & (F.col("all_elements") <= block_elements)
    placed = written(sized.join(pools.withColumnRenamed("pool", "pool_"), F.col("pool") == F.col("pool_")).select(
        "pool", "node", (F.col("root") == F.col("main_root")).alias("main"), F.when(small, F.lit(0)).otherwise(F.col("band")).alias("band"), "size"))
    blocks = written(placed.groupBy("pool", "band", "main").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("size") / block_elements)).alias("blocks")))
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    met = a.join(b, F.col("a_pool") == F.col("b_pool")).where(
        (F.abs(F.col("a_band") - F.col("b_band")) <= 1) & (F.struct("a_band", "a_main") <= F.struct("b_band", "b_main")) & ~(F.col("a_main") & F.col("b_main")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    met = met.withColumn("a_block", F.explode(upto("a_blocks"))).withColumn("b_block", F.explode(upto("b_blocks")))
    same = (F.col("a_band") == F.col("b_band")) & (F.col("a_main") == F.col("b_main"))
    met = met.where(~same | (F.col("a_block") <= F.col("b_block"))).withColumn("alone", same & (F.col("a_block") == F.col("b_block")))
    met = met.withColumn("task", F.xxhash64("a_pool", "a_band", "a_main", "a_block", "b_band", "b_main", "b_block"))

    def side(name: str) -> Column:
        return F.struct(*[F.col(f"{name}_{c}").alias(f"to_{c}") for c in ("pool", "band", "main", "block")],
                        F.lit(name == "a").alias("left"), (F.col("alone") | F.lit(name == "b")).alias("right"))

    sides = met.select("task", F.explode(F.when(F.col("alone"), F.array(side("a"))).otherwise(F.array(side("a"), side("b")))).alias("to")).select("task", "to.*")
    rows = placed.join(blocks.withColumnsRenamed({c: c + "_" for c in ("pool", "band", "main")}), (F.col("pool") == F.col("pool_")) & (
        F.col("band") == F.col("band_")) & (F.col("main") == F.col("main_"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    on = [F.col(c) == F.col(f"to_{c}") for c in ("pool", "band", "main", "block")]
    dealt = written(rows.join(sides, on[0] & on[1] & on[2] & on[3]).select("task", F.col("pool").alias("in_pool"), F.col("node").alias("of_node"), "left", "right"))

    def link(block: pa.Table) -> pa.Table:
        nodes, roots, sides = block.column("node").to_numpy(), block.column("root").to_numpy(), [block.column(c).to_numpy() for c in ("left", "right")]
        found = set_forest([np.asarray(x) for x in block.column("s").to_pylist()], *sides, roots, similarity)
        return pa.table({"a": pa.array([int(nodes[i]) for i, _ in found], pa.int64()), "b": pa.array([int(nodes[j]) for _, j in found], pa.int64())})

    both = sets.join(dealt, (F.col("node") == F.col("of_node")) & (F.col("pool") == F.col("in_pool"))).select("task", "node", "root", "s", "left", "right")
    return both.groupBy("task").applyInArrow(link, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def true_links(docs: DataFrame, points: DataFrame, width: int, similarity: float, text_col: str) -> DataFrame:
    """Links (a, b) of verified similarity that join all points of ``points`` which share a band and have it.

    Forests of the cells are verified first. Where a link of a forest does not hold, its two groups may still be joined by another
    pair of their points: groups that such links hang together are a pool, and the sets of a pool are joined exactly.
    """
    loose = written(_candidates(points, similarity))
    ends = written(loose.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(points, F.col("node") == F.col("point")).select("node", "text_hash"))
    wanted = ends.select("node", F.col("text_hash").alias("wanted_hash"))
    wanted = F.broadcast(wanted) if ends.count() <= BROADCAST_POINTS else wanted
    texts = docs.select(F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("own_hash")).join(wanted, F.col("own_hash") == F.col("wanted_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_set(t.as_py(), width).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["node", "s"])

    sets = written(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, s array<long>"))
    tree = written(verified(loose, sets, similarity))
    known = written(components(tree).select(F.col("node").alias("in_group"), "root"))

    def group(c: str) -> DataFrame:
        return known.select(F.col("in_group").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))

    open_links = loose.join(group("a"), F.col("a") == F.col("a_node"), "left").join(group("b"), F.col("b") == F.col("b_node"), "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b")
    pools = components(open_links).select(F.col("node").alias("pool_root"), F.col("root").alias("pool"))
    in_pools = sets.join(known, F.col("node") == F.col("in_group"), "left").withColumn("root", F.coalesce("root", "node")).join(
        pools, F.col("root") == F.col("pool_root")).select("node", "root", "pool", "s")
    return written(tree.union(joined_sets(written(in_pools), similarity)))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id (a null id is the largest).

    Texts are near duplicates if their sets of shingles have that Jaccard similarity. Pairs to compare share a band of least
    hashes (at exactly 0.8, all but three in a million do); each link is verified on the sets. Of several rows with that id one
    text stays, of repeated rows one. Texts without words are one group.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")).alias("k")
    points = written(sketches(docs, width, id_col, text_col).groupBy("point").agg(first, F.min("text_hash").alias("text_hash"), *(
        F.first(c).alias(c) for c in ("fp", "fp2", "size", "keys"))))
    roots = components(true_links(docs, points, width, similarity, text_col))
    groups = points.select("point", "k").join(roots, F.col("point") == F.col("node"), "left").groupBy(F.coalesce("root", "point").alias("group"))
    keep = written(groups.agg(F.min("k").alias("k")).select(
        F.col("k.id").alias(kid := fresh(docs, "keep_id")), F.col("k.text_hash").alias(kh := fresh(docs, "keep_hash"))))
    own, rank = fresh(docs, "own_hash"), fresh(docs, "rank")
    hashed = docs.withColumn(own, text_hash(F.col(text_col)))
    joined = hashed.join(keep, hashed[id_col].eqNullSafe(keep[kid]) & (hashed[own] == keep[kh]))
    order = W.partitionBy(id_col, own).orderBy(id_col)
    return joined.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
