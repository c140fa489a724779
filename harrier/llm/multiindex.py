"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the two codewords of a
vector name its cell in the product grid. A query visits cells in the order of
the summed distances of its halves to the codewords (the multi-sequence order)
until the target recall, and is compared with all vectors of the cells it
visits, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.components import connected_components

from .common import Scratch, bounded_broadcast, bounded_sample

SAMPLE_NUMBERS = 16_000_000  # components that a sample holds at most: 128 MB
BROADCAST_CELLS = 1_000_000


def unit(rows: pa.ListArray, dim: int) -> np.ndarray:
    return unit_rows(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means centres, started from rows that are drawn once and kept in order."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.sort(np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Codebooks of one vector length and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, codewords: int):
        self.books = [codebook(h, codewords) for h in halves(sample)]
        self.shape = len(self.books[0]), len(self.books[1])
        self.visits = self.shape[0] * self.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their codewords."""
        first, second = (squared(h, c) for h, c in zip(halves(x), self.books))
        return first, second

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = self.distances(x)
        return first.argmin(1) * self.shape[1] + second.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """(rows, visits): the cells in the multi-sequence order, nearest first.

        With each half's codewords sorted by distance, a pair (i, j) has at
        least (i + 1) (j + 1) - 1 pairs before it; so the nearest ``visits``
        are among those with (i + 1) (j + 1) <= visits, and no others are summed.
        """
        i, j = np.meshgrid(np.arange(self.shape[0]), np.arange(self.shape[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= self.visits
        i, j = i[near], j[near]
        first, second = self.distances(x)
        a, b = first.argsort(1, kind="stable"), second.argsort(1, kind="stable")
        sums = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
        order = sums.argsort(1, kind="stable")[:, : self.visits]
        return a[:, i][np.arange(len(x))[:, None], order] * self.shape[1] + b[:, j][np.arange(len(x))[:, None], order]

    def ranks(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each query and cell, how many cells the multi-sequence order has up to that one."""
        first, second = self.distances(queries)
        to = first[np.arange(len(cells)), cells // self.shape[1]] + second[np.arange(len(cells)), cells % self.shape[1]]
        second = np.sort(second, axis=1)
        left = to[:, None] - first + 1e-12
        return np.array([np.searchsorted(s, x, side="right").sum() for s, x in zip(second, left)], np.int64)


def calibrate(classes: DataFrame, index: dict[int, MultiIndex], threshold: float, recall: float, queries: int) -> None:
    """Set each index's visits: twice the cells after which about ``queries`` vectors, compared with all others, have met the share ``recall`` of their links.

    Where links are rare, the queries meet few of them. So each also gets made partners at the threshold itself, in
    random directions, and the visits reach all but a thousandth of these from one end or the other.
    """
    asked: dict[int, list] = {}
    for rep, v in bounded_sample(classes, queries, "h", "rep").select("rep", "v").collect():
        asked.setdefault(len(v), []).append((rep, v))
    known = {dim: (np.array([r for r, _ in q]), unit_rows(np.array([v for _, v in q], np.float64))) for dim, q in asked.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1)], np.int64)
            for dim in np.unique(lengths):
                if int(dim) not in known:
                    continue
                part = batch.filter(pa.array(lengths == dim))
                ids, x = part.column(0).to_numpy(), unit(part.column(1), int(dim))
                reps, q = known[int(dim)]
                i, j = np.nonzero(q @ x.T >= threshold)
                other = reps[i] != ids[j]
                i, j = i[other], j[other]
                own = index[int(dim)].cells(x)
                pairs, n = np.unique(np.stack([i, own[j]], axis=1), axis=0, return_counts=True)  # one rank for all of a query's links in a cell
                for rank, k in zip(index[int(dim)].ranks(q[pairs[:, 0]], pairs[:, 1]).tolist(), n.tolist()):
                    counts[int(dim), rank] = counts.get((int(dim), rank), 0) + k
        rows = [(d, r, k) for (d, r), k in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["dim", "rank", "n"])

    met = classes.select("rep", "v").mapInArrow(read, "dim long, rank long, n long").groupBy("dim", "rank").agg(F.sum("n").alias("n")).collect()
    for dim, book in index.items():
        found = sorted((rank, n) for d, rank, n in met if d == dim)
        ranks, n = np.array([r for r, _ in found] or [1]), np.cumsum([k for _, k in found] or [1])
        least = made_rank(book, known[dim][1], threshold) if dim in known else 1
        book.visits = int(min(book.shape[0] * book.shape[1], max(least, 2 * ranks[np.searchsorted(n, recall * n[-1])])))


def made_rank(book: MultiIndex, queries: np.ndarray, threshold: float, each: int = 4, share: float = 0.999) -> int:
    """The rank within which the share of made partners lie: vectors whose cosine to a query is the threshold, ``each`` for a query, seen from the end that ranks the other first."""
    q = np.repeat(queries, each, axis=0)
    if q.shape[1] < 2 or not len(q):
        return 1
    side = np.random.default_rng(len(queries)).standard_normal(q.shape)
    side -= (side * q).sum(1, keepdims=True) * q
    p = threshold * q + np.sqrt(1 - threshold**2) * unit_rows(side)
    ranks = np.minimum(book.ranks(q, book.cells(p)), book.ranks(p, book.cells(q)))
    return int(np.quantile(ranks, share, method="higher"))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def train(classes: DataFrame, codewords: int, sample: int, block: int) -> dict[int, MultiIndex]:
    """An index for each vector length, fitted on about ``sample`` vectors picked by their hashes, and on no more numbers than SAMPLE_NUMBERS.

    Each half has at least ``codewords`` words, and so many more that a cell
    holds about a quarter of ``block`` vectors, up to one for 16 of the sample.
    """
    n, numbers = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    picked = bounded_sample(classes, min(sample, SAMPLE_NUMBERS // max(1, numbers or 1)), "rep", "h").select("rep", "v").orderBy("rep").collect()
    words = max(codewords, min(int(np.ceil((4 * n / block) ** 0.5)), len(picked) // 16))
    by_length: dict[int, list] = {}
    for _, v in picked:
        by_length.setdefault(len(v), []).append(v)
    return {dim: MultiIndex(unit_rows(np.array(rows, np.float64)), words) for dim, rows in by_length.items()}


def embedding_near_duplicates(embeddings: DataFrame, threshold: float = 0.9, codewords: int = 24, recall: float = 1.0, sample: int = 20_000, queries: int = 1000, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings.

    Equal vectors are one class, compared once and counted as often as they
    occur. Cells and their visitors are dealt in blocks of about ``block``
    vectors, so a hot cell becomes many tasks; a block gives for each visitor
    the number of its links, and for its linked vectors a spanning star. A link
    that only one of its ends visits counts for both.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do those of another length or with a null vec_id
    (null component_id, kept). Other columns are ignored. The codebooks come
    from a sample of about ``sample`` vectors; a query goes on to twice the
    cells after which about ``queries`` vectors, compared with all others, have
    met the share ``recall`` of their links, and far enough for made partners at the threshold. All vectors are indexed and all are queries.
    """
    scratch = Scratch(embeddings.sparkSession, "multiindex")
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = usable(F.col("v")) & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("h", F.when(fine, F.struct(F.xxhash64("v").alias("x"), F.md5(F.to_json("v")).alias("y"))))
    classes = keyed.where("h IS NOT NULL").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    index = train(classes, codewords, sample, block)
    calibrate(classes, index, threshold, recall, queries)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(2)], np.int64)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                books, x = index.get(int(dim)), unit(part.column(2), int(dim))
                base = int(dim) << 32
                own = base + (books.cells(x) if books else np.zeros(len(x), np.int64))
                seen = base + (np.concatenate([books.visited(x[at : at + 1024]) for at in range(0, len(x), 1024)]) if books else np.zeros((len(x), 1), np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array(list(seen), pa.list_(pa.int64()))], names=["rep", "n", "v", "own", "seen"])

    placed = scratch.save(classes.select("rep", "n", "v").mapInArrow(place, "rep long, n long, v array<double>, own long, seen array<long>"), "placed")
    members = placed.select(F.col("own").alias("cell"), "rep", "n", "v", "own", "seen")
    visitors = placed.select(F.explode("seen").alias("cell"), "rep", "n", "v", "own", F.array().cast("array<long>").alias("seen"))
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
    grid = scratch.save(blocks(members, "mb").join(blocks(visitors, "vb"), "cell"), "grid")
    grid = bounded_broadcast(grid, grid.count(), BROADCAST_CELLS)
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = members.join(grid, "cell").withColumn("i", deal("mb")).withColumn("j", every("vb")).select("cell", "i", "j", F.lit(False).alias("asks"), "rep", "n", "v", "own", "seen")
    q = visitors.join(grid, "cell").withColumn("j", deal("vb")).withColumn("i", every("mb")).select("cell", "i", "j", F.lit(True).alias("asks"), "rep", "n", "v", "own", "seen")

    def compare(both: pa.Table) -> pa.Table:
        left, right = both.filter(pc.invert(both["asks"])), both.filter(both["asks"])
        out: list[np.ndarray] = []
        if len(left) and len(right):
            dim = len(left["v"][0])
            a, b = (unit(t["v"].combine_chunks(), dim) for t in (left, right))
            ids, weights, asks, asking = left["rep"].to_numpy(), left["n"].to_numpy(), right["rep"].to_numpy(), right["n"].to_numpy()
            homes, seen = right["own"].to_numpy(), left["seen"].combine_chunks().flatten().to_numpy().reshape(len(left), -1)
            lead, unasked = {}, np.zeros(len(left), np.int64)
            for at in range(0, len(b), 512):
                i, j = np.nonzero(b[at : at + 512] @ a.T >= threshold)
                x, y, w = asks[at + i], ids[j], weights[j]
                i, j, y, w, x = (z[x != y] for z in (at + i, j, y, w, x))
                for part in range(0, len(i), 1 << 16):  # links that the other end does not visit
                    k, m = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                    alone = ~(seen[m] == homes[k][:, None]).any(axis=1)
                    unasked += np.bincount(m[alone], weights=asking[k[alone]], minlength=len(left)).astype(np.int64)
                counts = np.bincount(i, weights=w, minlength=len(b)).astype(np.int64)
                hit = np.flatnonzero(counts)
                out.append(np.stack([asks[hit], np.full(len(hit), -1), counts[hit]]))
                _star(lead, x, y)
            hit = np.flatnonzero(unasked)
            out.append(np.stack([ids[hit], np.full(len(hit), -1), unasked[hit]]))
            ends = np.array([(k, _root(lead, k)) for k in lead], np.int64).reshape(-1, 2)
            ends = ends[ends[:, 0] != ends[:, 1]]
            out.append(np.stack([ends[:, 0], ends[:, 1], np.zeros(len(ends), np.int64)]))
        all_ = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
        return pa.table({"a": pa.array(all_[0]), "b": pa.array(all_[1]), "links": pa.array(all_[2]), "is_edge": pa.array(all_[1] != -1)})

    found = m.unionByName(q).groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, links long, is_edge boolean")
    found = scratch.save(found, "found")
    counts = found.where("NOT is_edge").groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("is_edge").select("a", "b"), scratch)
    known = classes.select("h", "rep", "n").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.save(known.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("root")), "known")
    out = keyed.select("vec_id", "h").join(known, "h", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _root(lead: dict[int, int], k: int) -> int:
    while lead[k] != k:
        lead[k] = lead[lead[k]]
        k = lead[k]
    return k


def _star(lead: dict[int, int], x: np.ndarray, y: np.ndarray) -> None:
    """Merge the links x-y of one block into its forest, smallest id leading."""
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    for a, b in pairs.T.tolist():
        lead.setdefault(a, a)
        lead.setdefault(b, b)
        a, b = _root(lead, a), _root(lead, b)
        if a != b:
            lead[max(a, b)] = min(a, b)
