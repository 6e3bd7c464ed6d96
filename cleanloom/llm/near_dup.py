"""MinHash near-dedup with an LSH forest.

1. Signatures. A document is the set of its distinct runs of five lower-cased words (all words as one run where
   there are fewer), as 64-bit hashes; MINIMA minima of hash functions sign it. Documents with equal sets form a class; its
   smallest id stands for it from here on.
2. Forest. TREES rotations of the signature give as many sorted orders. An order is dealt out by range, ties split by id, so
   that no common passage and no large group of copies meets in one task; the rows at the edges of a range meet once more with
   those of the next. Neighbours that share a first value form a region. Each pair of a region with at most REGION members is a
   candidate; a larger region is entered one value deeper where its common prefixes are shortest, again and again, and its next
   neighbours are candidates too. Candidates pass by the sizes of their sets (exact) and by four bits of every minimum
   (LEAST_EQUAL of MINIMA).
3. Rounds. Only classes of different components are compared. First each range names, of its candidates and the most alike
   first, those that could join what is apart: fewer than the range has rows. They are confirmed on full sets and join components.
   Then all candidates that are still apart are confirmed. So a large group of near copies costs a few pairs for each member.
4. Large regions. A class that fewer than SAFE_TREES orders have in small regions, counted over all ranges, is joined
   exactly with the others of its kind: by a prefix filter on full sets, rare shingles first. So no bound on a region loses a link.
Components of links are contracted in tasks of bounded size, then by alternating large and small stars. Ids and labels stay
distributed; each round is a written table, removed at the end.

A pair at the threshold is missed by a tree with probability 0.25, its first value being another one, so by the forest with
0.25 ** 16 where all its regions are small, and with 0.25 ** SAFE_TREES at most otherwise.

Defined results: null and empty texts, and texts without words, have 0 shingles and are linked with nothing;
a null id has a null component and is kept; repeated rows get equal results; rows of one id with several texts are one document,
linked where one of its texts is;
texts of any length are taken whole, long ones walked in parts, so that their shingles (some 5 bytes for each byte) are what takes
memory, but for a single word, which takes about 100 bytes for each of its own; ties of similarity don't
matter, as all links count; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as sh

WORDS = 5
MINIMA = 128
TREES = 16
#: Values of a signature that an order compares.
DEPTH = 8
#: Members of a region whose pairs are all candidates, at most; and rows at the edge of a range that meet the next one.
REGION = 32
#: A class that so many trees have in regions of at most REGION members meets all that it is linked with in one of them, but for a
#: chance of 0.25 ** SAFE_TREES. The others are joined exactly.
SAFE_TREES = 13
#: Of MINIMA four-bit values, so many are equal at a similarity of 0.75 but for a chance of about 2e-11, below that of the forest.
LEAST_EQUAL = 64
#: Rows of an order in a range, about.
RANGE_ROWS = 50_000
#: The prefix filter orders shingles by how often those with the same first bits occur; only the most frequent bits are
#: counted exactly. Any order gives the same links.
SKETCH_BITS = 18
COMMON = 1 << 15
#: Tasks that the pairs of one class are dealt to, at most.
SLOTS = 32
#: Edges that a task contracts, about.
LOCAL_EDGES = 200_000
#: Sets that are unpacked at a time.
SOME_SETS = 500
#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.default_rng(20_240_607)
_FACTORS = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = sh.text_buffer(texts)
    hashes, first = sh.word_hashes(sh.LOWER_BYTES[data], at)
    h = sh.mix64(hashes + np.uint64(words))
    whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        whole = sh.mix64(whole + h[i : i + len(whole)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(whole[a : b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = sh.mix64(x + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MINIMA 32-bit values for each (non-empty) set."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for k in range(MINIMA):
            out[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _TERMS[k], starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, n_shingles, key binary (a 128-bit hash of the set), sig binary (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in sh.slices(batch, 1):
                sets = shingle_sets(part.column(1))
                full = [k for k, x in enumerate(sets) if len(x)]
                keys, sigs = [None] * len(sets), [None] * len(sets)
                for k, row in zip(full, minima([sets[k] for k in full]).astype(">u4"), strict=True):
                    keys[k], sigs[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(sh.frugal(run), "doc_id bigint, n_shingles bigint, key binary, sig binary")


def region_pairs(values: np.ndarray, tree: np.ndarray, roots: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: index pairs of different roots, and where the regions of one first value start and end.

    A region of at most `region` members brings all its pairs. A larger one brings its next neighbours, and each of its parts at
    the depth of its shortest common prefix is a region again.
    """
    equal = np.logical_and.accumulate(values[1:] == values[:-1], axis=1)
    common = np.where(tree[1:] == tree[:-1], equal.sum(1), 0)
    starts = np.flatnonzero(np.append(True, common == 0)) if len(values) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(values)).astype(np.int64)[: len(starts)]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    upper = {}
    mixed = (ends - starts > 1) & (np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts)) if len(values) else np.empty(0, bool)
    runs = list(zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True))
    for a, b in runs:
        if b - a > region:
            i = a + np.flatnonzero(roots[a : b - 1] != roots[a + 1 : b])
            left.append(i)
            right.append(i + 1)
    while runs:
        a, b = runs.pop()
        own = roots[a:b]
        if (own == own[0]).all():
            continue
        if b - a <= region:
            i, j = upper.setdefault(b - a, np.triu_indices(b - a, 1))
            apart = own[i] != own[j]
            left.append(a + i[apart])
            right.append(a + j[apart])
            continue
        inner = common[a : b - 1]
        least = int(inner.min())
        if least < values.shape[1]:
            cut = a + np.flatnonzero(np.concatenate([[True], inner == least, [True]]))
            runs += [(c, d) for c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if d - c > 1]
    return np.concatenate(left), np.concatenate(right), starts, ends


def spanning(u: np.ndarray, v: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Positions of pairs (u, v), the most alike first, that join what the ones before left apart: fewer than there are different ends."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    order = np.argsort(-alike, kind="stable")
    for k, x, y in zip(order.tolist(), u[order].tolist(), v[order].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def sh_join(column: pa.ChunkedArray) -> bytes:
    column = column.combine_chunks().cast(pa.large_binary())
    if not len(column):
        return b""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2][ends[0] : ends[-1]].to_pybytes()


def _passing(i: np.ndarray, j: np.ndarray, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index pairs whose sizes and four-bit minima allow a link, and how many of the minima are equal."""
    found = [(np.empty(0, np.int64),) * 3]
    for k in range(0, len(i), 200_000):
        a, b = i[k : k + 200_000], j[k : k + 200_000]
        fits = 100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        differ = bits[a] ^ bits[b]
        equal = ((differ & 0x0F) == 0).sum(1) + ((differ & 0xF0) == 0).sum(1)
        close = equal >= LEAST_EQUAL
        found.append((a[close], b[close], equal[close]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


_ENTRY = "tree int, prefix binary, bits binary, rep bigint, n bigint, root bigint"
_ENTRY_NAMES = ["tree", "prefix", "bits", "rep", "n", "root"]
_PAIR = ["a", "b", "u", "v"]


def candidates(classes: DataFrame, many: int, folder: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """What the forest names among the `many` classes (rep, n, sig, bits, root).

    First: pairs a < b of classes whose roots u, v differ, the more alike ones that suffice to join what a range could join, or
    (whole) all. Second: tree, first of the regions with more than REGION members of several roots, counted over all ranges.
    """
    step, width = MINIMA // TREES, 4 * DEPTH
    doubled = F.concat("sig", F.substring("sig", 1, width))
    wide = classes.select("rep", "n", doubled.alias("__sig"), "bits", "root").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    entries = wide.select("tree", F.expr(f"substring(__sig, tree * {4 * step} + 1, {width})").alias("prefix"), "bits", "rep", "n", "root")
    order = ["tree", "prefix", "rep"]
    ranges = max(1, many * TREES // RANGE_ROWS)
    kinds = dict.fromkeys(_PAIR, pa.int64()) | {"border": pa.int32(), "tree": pa.int32(), "prefix": pa.binary(), "bits": pa.binary(), "rep": pa.int64(), "n": pa.int64(), "root": pa.int64(), "members": pa.int64(), "least": pa.int64(), "last": pa.int64()}
    size = REGION

    def told(**columns) -> pa.RecordBatch:
        """Rows with these columns; the others are null."""
        m = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if isinstance(columns.get(c), (list, np.ndarray)) else columns[c].combine_chunks().cast(t) if c in columns else pa.nulls(m, t) for c, t in kinds.items()], names=list(kinds))

    def found_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs; and the regions of several roots that are large, or the first or last of the range."""
        fixed = lambda name, kind: np.frombuffer(sh_join(rows[name]), kind).reshape(len(rows), -1)
        tree, values, ids, n, roots = rows["tree"].to_numpy(), fixed("prefix", ">u4"), rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["root"].to_numpy()
        i, j, starts, ends = region_pairs(values, tree, roots, size)
        i, j, alike = _passing(i, j, fixed("bits", np.uint8), n)
        if not whole:
            some = spanning(roots[i], roots[j], alike)
            i, j = i[some], j[some]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        yield told(a=ids[i], b=ids[j], u=roots[i], v=roots[j])
        if whole:
            least, last, many = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts), ends - starts
            large = (many > size) & (least < last)
            large[[0, -1]] = True
            yield told(tree=tree[starts[large]], prefix=[x.tobytes() for x in values[starts[large], :1]], members=many[large], least=least[large], last=last[large])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if got:
            rows = pa.Table.from_batches(got)
            yield from found_in(rows)
            here = TaskContext.get().partitionId()
            for border, edge in ((here - 1, rows.slice(0, size)), (here, rows.slice(max(0, len(rows) - size)))):
                yield told(border=[border] * len(edge), **{c: edge[c] for c in _ENTRY_NAMES})

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("prefix", "ascending"), ("rep", "ascending")])
        return pa.Table.from_batches(found_in(rows)).select(_PAIR).filter(pc.is_valid(pc.field("a")))

    pair = ", ".join(f"{c} bigint" for c in _PAIR)
    schema = f"{pair}, border int, {_ENTRY}, members bigint, least bigint, last bigint"
    found = sh.written(entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(sh.frugal(run), schema), "candidates", folder)
    # The end of a range meets the start of the next one. Each range but the last has rows, as the last row of each is one of the order.
    met = found.where(F.col("border").isNotNull()).select("border", *_ENTRY_NAMES).groupBy("border").applyInArrow(across, pair)
    regions = found.where(F.col("members").isNotNull()).groupBy("tree", F.col("prefix").alias("first")).agg(F.sum("members").alias("members"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least"), F.max("last").alias("last"))
    # Parts in two ranges meet at the border; those of three don't.
    regions = regions.where(((F.col("members") > REGION) | (F.col("parts") > 2)) & (F.col("least") < F.col("last"))).select("tree", "first")
    return found.where(F.col("a").isNotNull()).select(_PAIR).unionByName(met).dropDuplicates(["a", "b"]), regions


def crowded(classes: DataFrame, regions: DataFrame) -> DataFrame:
    """id, root of the classes (rep, sig, root) that fewer than SAFE_TREES trees have in small regions."""
    step = 4 * (MINIMA // TREES)
    firsts = classes.select("rep", "root", F.posexplode(F.array(*(F.substring("sig", step * t + 1, 4) for t in range(TREES)))).alias("tree", "first"))
    return firsts.join(regions, ["tree", "first"], "left_semi").groupBy(F.col("rep").alias("id"), "root").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > TREES - SAFE_TREES).select("id", "root")


def _weights(sets: DataFrame) -> dict[int, int]:
    """How often shingles with the most frequent first bits occur in the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            items = np.frombuffer(sh_join(pa.chunked_array([batch.column(0)])), np.uint64)
            n += np.bincount((items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["first", "n"])

    counts = sets.select("items").mapInArrow(sh.frugal(run), "first bigint, n bigint").groupBy("first").agg(F.sum("n").alias("n"))
    return {r["first"]: r["n"] for r in counts.orderBy(F.desc("n"), "first").limit(COMMON).collect()}


def prefixes(sets: DataFrame) -> DataFrame:
    """item, id, root, n, place of the shingles of each set (id, root, items) of which two sets at 0.75 share one: all but three quarters of it, the rarest first, and one more."""
    weights = _weights(sets)
    keys, values = np.array([*weights], np.int64), np.array([*weights.values()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << SKETCH_BITS, np.int64)
        weight[keys] = values
        for batch in (b.slice(k, SOME_SETS) for b in batches for k in range(0, len(b), SOME_SETS)):
            kept, n = [], []
            for items in batch.column(2).to_pylist():
                x = np.frombuffer(items, np.uint64)
                order = np.lexsort((x, weight[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                kept.append(x[order[: len(x) // 4 + 1]])
                n.append(len(x))
            many = np.array([len(x) for x in kept], np.int64)
            of = np.repeat(np.arange(len(many)), many)
            place = sh.ragged(np.zeros(len(many), np.int64), many)
            item = np.concatenate([*kept, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.array(n, np.int32)[of], pa.int32()), pa.array(place.astype(np.int32))], names=["item", "id", "root", "n", "place"])

    return sets.select("id", "root", "items").mapInArrow(sh.frugal(run), "item bigint, id bigint, root bigint, n int, place int")


def joined(sets: DataFrame, folder: str) -> DataFrame:
    """Distinct pairs a < b of the sets (id, root, items) whose roots u, v differ: all at 0.75 or more, and others.

    Shingles of one root name no pair. Of the others, the members outside a shingle's main root meet all its members; they pass
    by what is left of both from that shingle on, which must hold 3 / 7 of both sizes.
    """
    rows = sh.written(prefixes(sets), "prefixes", folder)
    of_root = rows.groupBy("item", "root").agg(F.count(F.lit(1)).alias("__n"))
    main = of_root.groupBy("item").agg(F.max(F.struct("__n", "root")).alias("__top"), F.count(F.lit(1)).alias("__roots")).where("__roots > 1").select("item", F.col("__top.root").alias("__main"))
    mixed = sh.written(rows.join(main, "item"), "mixed", folder)
    others = mixed.where("root <> __main").select("item", F.col("id").alias("__id"), F.col("root").alias("__root"), F.col("n").alias("__n"), F.col("place").alias("__place"))
    fits = "root <> __root AND 7 * least(n - place, __n - __place) >= 3 * (n + __n) AND 4 * least(n, __n) >= 3 * greatest(n, __n)"
    ends = F.when(F.col("id") < F.col("__id"), F.struct("id", "__id", "root", "__root")).otherwise(F.struct(F.col("__id").alias("id"), F.col("id").alias("__id"), F.col("__root").alias("root"), F.col("root").alias("__root")))
    return others.join(mixed.drop("__main"), "item").where(fits).select(ends.alias("e")).select(F.col("e.id").alias("a"), F.col("e.__id").alias("b"), F.col("e.root").alias("u"), F.col("e.__root").alias("v")).dropDuplicates(["a", "b"])


def sets_of(docs: DataFrame, ids: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """id, sets array<binary> (the distinct sets, each sorted 64-bit hashes, of the texts under the id) for each of at most `most` distinct ids."""
    few = most <= BROADCAST_IDS
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi" if few else "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(part.column(1))], pa.binary())], names=["id", "items"])

    return mine.select("id", "text").mapInArrow(sh.frugal(run), "id bigint, items binary").groupBy("id").agg(F.collect_set("items").alias("sets"))


def confirmed(pairs: DataFrame, many: int, docs: DataFrame, id_col: str, text_col: str, percent: int = 75) -> DataFrame:
    """u, v of the `many` pairs (a, b, u, v) with 100 * intersection >= percent * union. Each b's sets travel once a pair; each a's, once
    to each of SLOTS tasks that its pairs are dealt to, so that an a with many pairs is no task's burden."""
    pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(SLOTS)).cast("int"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    heads = pairs.select("a", "slot", F.col("a").alias("id"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v")).distinct()
    rows = heads.unionByName(pairs.select("a", "slot", F.col("b").alias("id"), "u", "v")).join(sets_of(docs, ids, 2 * many, id_col, text_col), "id")
    rows = rows.select("a", "slot", F.col("u").isNotNull().alias("member"), "u", "v", "sets")

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if not len(x) or not len(y):
            return False
        at = np.searchsorted(x, y)
        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[np.ndarray] = []
        for batch in (b.slice(k, SOME_SETS) for b in batches for k in range(0, len(b), SOME_SETS)):
            kept = []
            for member, u, v, sets in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in sets]
                if not member:
                    mine = sets
                elif any(alike(x, y) for x in mine for y in sets):
                    kept.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return rows.repartition("a", "slot").sortWithinPartitions("a", "slot", "member").mapInArrow(sh.frugal(run), "u bigint, v bigint")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges (u, v), and the smallest end that each reaches; without those that are their own."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _print(df: DataFrame) -> tuple:
    """What tells whether a set of distinct rows has changed."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id, root: the smallest id that each end of the edges (a table u, v) reaches, for ends that reach a smaller one.

    Tasks of about LOCAL_EDGES edges contract what they hold. What several of them leave alternates large and small stars until
    nothing changes.
    """
    tasks = max(1, -(-edges.count() // LOCAL_EDGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        u, v = contracted(got["u"].to_numpy(), got["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    edges = sh.written(edges.repartition(tasks).mapInArrow(sh.frugal(run), "u bigint, v bigint"), "edges", folder)
    last = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima as tables: both sides of a join are then plain exchanges, and the rows of a star's centre can be split.
        least = sh.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", folder)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = sh.written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges", folder)
        least = sh.written(down.groupBy("u").agg(F.min("v").alias("m")), "least", folder)
        small = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = sh.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges", folder)
        now = _print(edges)
        if now == last:
            edges = edges.groupBy("u").agg(F.min("v").alias("v"))
            break
        last = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def linked(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """id, root for each class that is linked with a smaller one."""
    many, met, links, roots = classes.count(), None, [], None

    def labelled() -> DataFrame:
        if roots is None:
            return classes.withColumn("root", F.col("rep"))
        of = roots.select(F.col("id").alias("rep"), F.col("root").alias("__root"))
        return sh.written(classes.join(of, "rep", "left").select(*classes.columns, F.coalesce("__root", "rep").alias("root")), "labelled", folder)

    def merged(pairs: DataFrame) -> None:
        """The roots after the links among those pairs."""
        nonlocal roots
        if n := pairs.count():
            links.append(sh.written(confirmed(pairs, n, docs, id_col, text_col), "links", folder))
            roots = components(functools.reduce(DataFrame.unionByName, links), folder)

    for whole in (False, True):
        pairs, regions = candidates(labelled(), many, folder, whole)
        pairs = sh.written(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"), "pairs", folder)
        met = pairs.select("a", "b") if met is None else met.unionByName(pairs.select("a", "b"))
        merged(pairs)
    # What large regions still hold apart.
    crowd = sh.written(crowded(labelled(), regions), "crowd", folder)
    there = crowd.agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("apart")).first()
    if there["apart"]:
        sets = sets_of(docs, crowd.select("id"), there["n"], id_col, text_col).join(crowd, "id").select("id", "root", F.explode("sets").alias("items"))
        merged(sh.written(joined(sh.written(sets, "sets", folder), folder).join(met, ["a", "b"], "left_anti"), "pairs", folder))
    return roots if roots is not None else docs.sparkSession.createDataFrame([], "id bigint, root bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, n_shingles, component_id, kept."""
    signed = sh.written(signatures(docs, id_col, text_col), "near-signatures")
    real = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = real.groupBy("key", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    classes = sh.written(_with_bits(classes), "near-classes")
    folder = sh.scratch(docs.sparkSession, "near")
    roots = sh.written(linked(docs, classes, id_col, text_col, folder), "near-roots")
    sh.removed(docs.sparkSession, folder)
    rep = classes.select("key", F.col("n").alias("n_shingles"), "rep")
    rep = rep.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("key", "n_shingles", F.coalesce("root", "rep").alias("rep"))
    found = signed.select("doc_id", "n_shingles", "key").join(rep, ["key", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _with_bits(classes: DataFrame) -> DataFrame:
    """Adds bits: the last four bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            low = (np.frombuffer(sh_join(table["sig"]), ">u4").reshape(len(table), -1) & 15).astype(np.uint8)
            packed = low[:, ::2] << 4 | low[:, 1::2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in packed], pa.binary())], names=[*batch.schema.names, "bits"])

    return classes.mapInArrow(sh.frugal(run), "key binary, n bigint, rep bigint, sig binary, bits binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    keep = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__keep_id")).distinct()
    return docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")), "left_semi")
