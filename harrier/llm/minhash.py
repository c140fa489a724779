"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by longest common prefix.

Every distinct shingle set gets ``trees * depth`` MinHash labels. A tree is the
sets sorted by its own ``depth`` labels; sets that share a prefix stand side by
side, and a task reads a stretch of that order. Sets that share ``least``
labels form a region. The first scan reads a region of more than ``most`` sets
one label deeper, and so on; the second reads regions whole, in blocks.
Within a region the labels of all trees estimate the similarity, and pairs that
can be links are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.operators.components import connected_components

from .common import Scratch, bounded_broadcast

U = np.uint64
BROADCAST_IDS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, A-Z lower-cased; fewer words are one shingle, none give none."""
    words = text.lower().split()  # on bytes: ASCII letters and the six ASCII white space bytes only
    if not words:
        return np.empty(0, U)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], U)
    w = min(width, len(h))
    value = np.full(len(h) - w + 1, w, U)
    for k in range(w):
        value = mix(value + h[k : len(h) - w + 1 + k])
    return np.unique(value)


def signer(n: int, seed: int = 7):
    factors = np.random.default_rng(seed).integers(0, 2**63, n, dtype=U) * U(2) + U(1)

    def labels(values: np.ndarray) -> np.ndarray:
        least = np.full(len(factors), np.iinfo(U).max, U)
        for at in range(0, len(values), 4096):
            least = np.minimum(least, np.multiply.outer(factors, values[at : at + 4096]).min(axis=1))
        return (mix(least) >> U(48)).astype(">u2")  # the minimum of many values begins with zeros

    return labels


def signatures(docs: DataFrame, width: int, keys: int, sketch: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (the set's hash), labels (``keys`` of 16 bits), sketch (``sketch`` of 8 bits, the same ones first)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = signer(sketch)
        for batch in batches:
            n, h1, h2, sorts, sketches = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or b"", width)
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=U).view(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(s * U(0x9E3779B97F4A7C15)), initial=U(0)).view(np.int64)))
                found = labels(s)
                sorts.append(found[:keys].tobytes())
                sketches.append((found & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sorts, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "labels", "sketch"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return own.mapInArrow(rows, "doc_id long, n long, h1 long, h2 long, labels binary, sketch binary")


def regions(keys: np.ndarray, tree: np.ndarray, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches [from, to) of a sorted order that share a prefix as long as keeps them within ``most`` sets; keys: (rows, depth)."""
    depth = keys.shape[1]
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])

    def cut(a: int, b: int, d: int) -> Iterator[tuple[int, int]]:
        ends = a + 1 + np.flatnonzero(same[a : b - 1] < d)
        for x, y in zip([a, *ends], [*ends, b]):
            if y - x < 2:
                continue
            if y - x <= most:
                yield x, y
            elif d < depth:
                yield from cut(x, y, d + 1)
            else:  # equal labels throughout: neighbours in stretches that overlap by one
                for z in range(x, y - 1, most - 1):
                    yield z, min(z + most, y)

    if len(keys) > 1:
        yield from cut(0, len(keys), least)


def common_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of the number of labels that the rows of x and y have in common."""
    if len(x) * len(y) < 4096:
        return (x[:, None, :] == y[None, :, :]).sum(axis=2, dtype=np.int16)
    out = np.zeros((len(x), len(y)), np.int16)
    mine, theirs = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    step = max(1, (1 << 17) // len(y))
    for a in range(0, len(x), step):
        part = out[a : a + step]
        hit, count = np.empty(part.shape, bool), np.zeros(part.shape, np.uint8)
        for k in range(len(mine)):
            np.equal(mine[k, a : a + step, None], theirs[k], out=hit)
            count += hit.view(np.uint8)
            if k % 255 == 254 or k == len(mine) - 1:
                part += count
                count[:] = 0
    return out


def agreement(mine: tuple, theirs: tuple, agree: int, share: float) -> np.ndarray:
    """common_labels of (ids, sizes, sketches) with others; 0 where that or the sizes' ratio is too low for a link, and for a set with itself."""
    out = common_labels(mine[2], theirs[2])
    low, high = np.minimum.outer(mine[1], theirs[1]), np.maximum.outer(mine[1], theirs[1])
    out[(out < agree) | (low < share * high - 1e-9) | (mine[0][:, None] == theirs[0][None, :])] = 0
    return out


def spanning(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set with the first set, in the order of ids, that is similar and not taken by one before."""
    alive, i, j = np.ones(len(match), bool), [], []
    for p in range(len(match)):
        if alive[p]:
            near = np.flatnonzero((match[p] > 0) & alive)
            near = near[near > p]
            alive[near] = False
            i.append(near)
            j.append(np.full(len(near), p))
    return np.concatenate(i), np.concatenate(j)


def columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """Columns of all batches as arrays; binary ones, of one length, as a row of bytes each."""
    table = pa.Table.from_batches(list(batches))
    whole = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(len(table), -1)
    return [whole(c) if pa.types.is_binary(table.schema.field(c).type) else table[c].to_numpy() for c in names]


def unique_pairs(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])


def with_trees(rows: DataFrame, trees: int, depth: int, labels: int) -> DataFrame:
    """The rows once for each tree, with the first ``labels`` of its labels as key."""
    by_tree = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return by_tree.withColumn("key", F.expr(f"substring(labels, tree * {2 * depth} + 1, {2 * labels})")).drop("labels")


def first_scan(rows: DataFrame, trees: int, depth: int, least: int, most: int, agree: int, share: float) -> DataFrame:
    """Candidate pairs (a > b) that span the regions of all trees. rows: doc_id, n, labels, sketch.

    It only has to bring large groups together cheaply: crowded regions are cut
    and range boundaries part some; between_scan leaves no pair out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        pairs: list[np.ndarray] = []
        if batches:
            tree, keys, ids, sizes, sketch = columns(batches, "tree", "key", "doc_id", "n", "sketch")
            for a, b in regions(np.ascontiguousarray(keys).view(">u2"), tree, least, most):
                order = a + np.argsort(ids[a:b], kind="stable")
                own = ids[order], sizes[order], sketch[order]
                match = agreement(own, own, agree, share)
                if match.any():
                    i, j = spanning(match)
                    pairs.append(np.stack([np.maximum(own[0][i], own[0][j]), np.minimum(own[0][i], own[0][j])]))
        yield unique_pairs(pairs)

    order = ["tree", "key", "doc_id"]
    by_tree = with_trees(rows, trees, depth, depth).select(*order, "n", "sketch")
    return by_tree.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(read, "a long, b long").distinct()


def star_cells(pairs: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Cells of the pairs: each b asks its a's, in one cell for about every ``block`` of them."""
    crowded = scratch.save(pairs.groupBy("b").count().where(F.col("count") > block), "crowded")
    dealt = pairs.join(bounded_broadcast(crowded, crowded.count(), BROADCAST_IDS), "b", "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("count") / block), F.lit(1)))
    dealt = dealt.withColumn("cell", F.xxhash64("b", part))
    told = dealt.select("cell", F.col("a").alias("id"), F.array("b").alias("partners"))
    return told.unionByName(dealt.select("cell", F.col("b").alias("id"), F.lit(None).cast("array<bigint>").alias("partners")).distinct())


ITEM = ("doc_id", "n", "comp", "outside", "sketch", "roots")


def between_scan(rows: DataFrame, trees: int, depth: int, least: int, block: int, agree: int, share: float, scratch: Scratch) -> DataFrame:
    """Cells (cell, id, partners) of all similar pairs between the components of each region. rows: doc_id, n, labels, sketch, comp.

    A region is all sets with the same ``least`` first labels in a tree, however
    many. Of two sets of different components at least one is outside the
    region's largest; those outside ask all others. Askers and sets are
    dealt in packs of about ``block``, and each pack of askers meets each of
    sets, so every pair of a region between components is compared; pairs that
    share a region in several trees count in the first.

    In a cell, rows with partners are told which askers to be compared with, and
    the askers' own rows have none. Cells hold about ``2 * block`` askers and
    their shingles about 32 MB; the told sets only pass by.
    """
    roots = F.concat(*(F.expr(f"substring(labels, {2 * depth * t + 1}, {2 * least})") for t in range(trees)))
    by_tree = with_trees(rows.withColumn("roots", roots), trees, depth, least)
    parts = by_tree.groupBy("tree", "key", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("mass"))
    crowd = parts.groupBy("tree", "key").agg(F.sum("count").alias("all"), F.sum("mass").alias("mass"), F.max(F.struct("count", "comp", "mass")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    asking = F.col("all") - F.col("top.count")
    crowd = crowd.select("tree", "key", F.col("top.comp").alias("top"), blocks(F.col("all")).alias("sb"), blocks(asking).alias("ab"), asking.alias("asking"), (F.col("mass") - F.col("top.mass")).alias("mass"))
    crowd = scratch.save(crowd, "regions")
    n_regions, n_asking, mass = crowd.agg(F.count("*"), F.coalesce(F.sum("asking"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0))).first()
    asker_blocks = max(1, -(-n_asking // (2 * block)), -(-mass // (1 << 22)))
    told_blocks = max(1, -(-rows.count() // (2 * block)))

    live = by_tree.join(bounded_broadcast(crowd.drop("asking", "mass"), n_regions, BROADCAST_IDS), ["tree", "key"]).withColumn("outside", F.col("comp") != F.col("top"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    packs = lambda df, n: df.groupBy("tree", "key", "sb", "ab", deal(n).alias("k")).agg(F.collect_list(F.struct(*ITEM)).alias("items"))
    told = packs(live, "sb").select("tree", "key", F.col("k").alias("i"), every("ab").alias("j"), F.lit(False).alias("asks"), "items")
    asks = packs(live.where("outside"), "ab").select("tree", "key", every("sb").alias("i"), F.col("k").alias("j"), F.lit(True).alias("asks"), "items")
    cell = ["tree", "key", "i", "j"]
    met = told.unionByName(asks).repartition(*cell).sortWithinPartitions(*cell, "asks")

    def unpacked(items: pa.StructArray) -> tuple[np.ndarray, ...]:
        ids, n, comp, outside = (items.field(c).to_numpy(zero_copy_only=False) for c in ITEM[:4])
        sketch, own = (np.frombuffer(b"".join(items.field(c).to_pylist()), np.uint8).reshape(len(items), -1) for c in ITEM[4:])
        return ids, n, comp, outside, sketch, own.reshape(len(items), trees, -1)

    def similar(tree: int, sets: tuple, askers: tuple) -> tuple[np.ndarray, np.ndarray]:
        between = agreement((askers[0], askers[1], askers[4]), (sets[0], sets[1], sets[4]), agree, share)
        between[askers[2][:, None] == sets[2][None, :]] = 0
        i, j = np.nonzero(between)
        once = ~sets[3][j] | (askers[0][i] > sets[0][j])  # where both ask, one does
        i, j = i[once], j[once]
        if tree and len(i):
            first = ~(askers[5][i, :tree] == sets[5][j, :tree]).all(axis=2).any(axis=1)
            i, j = i[first], j[first]
        return askers[0][i], sets[0][j]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            out: list[tuple] = []
            for *place, asks, items in zip(*(batch.column(c).to_pylist() for c in ("tree", "key", "i", "j", "asks")), batch.column("items")):
                if place != at:
                    at, sets = place, []
                pack = unpacked(items.values)
                if not asks:
                    sets.append(pack)
                    continue
                for other in sets:
                    out += cells_of(*similar(place[0], other, pack), asker_blocks, told_blocks)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, CELL)], names=["cell", "id", "partners"])

    found = met.mapInArrow(read, "cell long, id long, partners array<long>")
    return found.groupBy("cell", "id", F.col("partners").isNull().alias("asks")).agg(F.flatten(F.collect_list("partners")).alias("p")).select("cell", "id", F.when(~F.col("asks"), F.col("p")).alias("partners"))


CELL = (pa.int64(), pa.int64(), pa.list_(pa.int64()))


def cells_of(askers: np.ndarray, told: np.ndarray, asker_blocks: int, told_blocks: int) -> list[tuple]:
    """The pairs as (cell, id, partners) rows: one for each told set of a cell, and one without partners for each asker."""
    cell = (mix(askers.astype(U)) % U(asker_blocks)).astype(np.int64) << 32 | (mix(told.astype(U)) % U(told_blocks)).astype(np.int64)
    order = np.lexsort((askers, told, cell))
    askers, told, cell = askers[order], told[order], cell[order]
    ends = np.flatnonzero((np.diff(told) != 0) | (np.diff(cell) != 0)) + 1
    rows = [(int(cell[a]), int(told[a]), askers[a:b].tolist()) for a, b in zip([0, *ends], [*ends, len(told)]) if b > a]
    return rows + [(int(c), int(a), None) for c, a in {*zip(cell.tolist(), askers.tolist())}]


def confirm(cells: DataFrame, components: DataFrame | None, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose full sets have 100 * intersection >= percent * union, enough of each cell to join what its pairs join.

    Each text goes to each of its cells once. A pair of which both sets are
    known to be in one component is not compared again.
    """
    cells = scratch.save(cells, "cells")
    ids = cells.select("id").distinct()
    comp = F.col("id") if components is None else F.coalesce("component", "id")
    ids = ids if components is None else ids.join(components.withColumnRenamed("node", "id"), "id", "left")
    ids = scratch.save(ids.select("id", comp.alias("comp")), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    texts = scratch.save(texts.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "id"), "texts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, askers, lead = None, {}, {}

        def root(x: int) -> int:
            while (up := lead.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            out: tuple[list, list] = ([], [])
            for cell, i, comp, partners, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "comp", "partners")), batch.column("text")):
                if cell != at:
                    at, askers, lead = cell, {}, {}
                own = shingle_set(text.as_py() or b"", width)
                if partners is None:
                    askers.setdefault(i, (comp, []))[1].append(own)
                    continue
                for p in partners:
                    x, y = root(comp), root(askers[p][0])
                    if x != y and any(like(own, other, percent) for other in askers[p][1]):
                        lead[max(x, y)] = min(x, y)
                        out[0].append(i)
                        out[1].append(p)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    full = cells.join(texts, "id").withColumn("told", F.col("partners").isNotNull())
    ordered = full.repartition("cell").sortWithinPartitions("cell", "told", "id")
    return ordered.select("cell", "id", "comp", "partners", "text").mapInArrow(read, "a long, b long").distinct()


def like(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union, and something in common."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short):
        return False
    both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 12, depth: int = 8, least: int = 3, most: int = 512, sketch: int = 384, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows with the same set are one class, compared once. The first scan gives
    pairs that span the similar sets of each region; confirmed, they bring
    large groups together at the cost of about one comparison a set and tree.
    The second reads all sets and whole regions of any size and gives every
    similar pair that is still between components, and all of these are
    compared on their full sets. So no pair of a large group is confirmed that
    cannot join two components, and none that can is left out.

    A link of similarity 0.8 shares ``least`` labels in none of the trees once
    in 5,000 times; candidates whose labels agree less than 4.2 standard
    deviations below that similarity are not confirmed. The first scan counts
    the sorted labels, the second all ``sketch`` labels, as it asks of the
    sets that are nearly similar. Null and empty texts
    have no shingles and link with nothing; rows that share a doc_id count as
    one document; a null doc_id links with nothing, has a null component_id and
    is kept. Other columns of docs are ignored. Tables that are not read again
    are deleted from ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    share = percent / 100
    k = trees * depth
    agree = lambda k: int(k * share - 4.2 * (k * share * (1 - share)) ** 0.5)
    signed = scratch.save(signatures(docs, width, k, sketch), "signatures")
    own = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = own.join(classes.withColumnsRenamed({"rep": "doc_id"}), ["doc_id", "h1", "h2", "n"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "n", "labels", "sketch")
    reps = scratch.save(reps, "sets")

    brief = reps.withColumn("sketch", F.substring("sketch", 1, k))
    pairs = scratch.save(first_scan(brief, trees, depth, least, most, agree(k), share), "pairs")
    links = scratch.save(confirm(star_cells(pairs, 2 * most, scratch), None, docs, width, percent, scratch), "links")
    scratch.keep_only(signed, classes, reps, links)
    final = scratch.save(connected_components(links, scratch), "components")
    placed = reps.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    cells = between_scan(placed, trees, depth, least, 4 * most, agree(sketch), share, scratch)
    found = scratch.save(confirm(cells, final, docs, width, percent, scratch), "links")
    if not found.isEmpty():
        final = scratch.save(connected_components(links.union(found), scratch), "components")

    rep = classes.join(final, classes.rep == final.node, "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("root"))
    rep = scratch.save(rep, "roots")
    scratch.keep_only(signed, rep)
    out = signed.select("doc_id", "n", "h1", "h2").join(rep, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
