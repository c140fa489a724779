"""Best-fit packing whose bin counts are certified by dual-feasible functions.

Token pieces go to partitions of bounded size; each packs its pieces by
best-fit decreasing and computes a lower bound on its bin count. A partition
that meets its bound is done. The others keep their full bins, pool the pieces
of the rest, deal them anew and pack again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TOKENIZER = "byte_bpe_50k"
END_OF_TEXT = 2
CACHED_CHARS = 64  # longer chunks are encoded each time, so the cache is bounded in bytes


class ChunkEncoder:
    """Token ids of whole texts as little-endian bytes, the same as the tokenizer file gives.

    A space between two other non-space characters always starts a new
    pre-token, so a text can be cut there and each chunk encoded once for all
    its occurrences. The chunks go through the same vocabulary's ranks; a text
    with a special token's string goes to the tokenizer itself.
    """

    def __init__(self, name: str = TOKENIZER, keep: int = 400_000):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.keep = keep

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        if not all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            joined: list[str] = []  # put the parts beside other white space back together
            for p in parts:
                if joined and not (p and joined[-1] and not p[0].isspace() and not joined[-1][-1].isspace()):
                    joined[-1] += " " + p
                else:
                    joined.append(p)
            parts = joined
        seen, out = self.seen, []
        space = ""
        for p in parts:
            key = space + p
            space = " "
            ids = seen.get(key)
            if ids is None:
                ids = np.array(self.encode(key), "<u4").tobytes()
                if len(seen) < self.keep and len(key) <= CACHED_CHARS:
                    seen[key] = ids
            out.append(ids)
        return b"".join(out)


def tokenize(docs: DataFrame, most: int = 1024, tokenizer: str = TOKENIZER, ids: bool = False) -> DataFrame:
    """Pieces of at most ``most`` tokens: doc_id, piece, start, length, ids_crc32 (and ids on request).

    A document's ids are its text's, then the end-of-text id; only documents
    longer than ``most`` are cut, all pieces but the first being full. A null
    text is empty. Rows that repeat are documents of their own.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(tokenizer), np.array([END_OF_TEXT], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder(text.as_py() or "") + end
                n, at, piece = len(data) // 4, 0, 0
                while at < n:
                    to = at + (n % most or most) if piece == 0 else at + most
                    part = data[4 * at : 4 * to]
                    out.append((doc, piece, at, to - at, zlib.crc32(part), part))
                    at, piece = to, piece + 1
            cols = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Of the bins that fit, the one with the least room takes the item."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(most + 1)]
    mask = n = 0  # bit r of the mask: there is a bin with room r
    for i in order:
        size = int(lengths[i])
        fitting = mask >> size
        if fitting and size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = most, n, n + 1
        bins[i], offsets[i] = b, most - room
        if left := room - size:
            with_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def lower_bound(counts: np.ndarray, most: int) -> int:
    """The best bound that two families of dual-feasible functions give; counts[s]: items of size s.

    With sizes as shares x of a bin: f(x) is 1 above 1 - a, x down to a, 0 below;
    u(x) is x where (k + 1) x is whole, else floor((k + 1) x) / k. The values of
    items that share a bin add up to 1 at most, so their sum bounds the bins.
    """
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // most)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    for a in range(1, most // 2 + 1):
        big = most - a + 1  # sizes above most - a
        best = max(best, int(above[big]) - (-int(mass[a] - mass[big]) // most))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        value = np.where(scaled % most == 0, k * sizes, most * (scaled // most))
        best = max(best, -(-int((counts * value).sum()) // (k * most)))
    return best


def pack(pieces: DataFrame, most: int = 1024, per_partition: int = 50_000, rounds: int = 3) -> DataFrame:
    """The pieces with sequence_id and offset, and the certificate of their partition: its bins and the bound that no packing of its pieces can go below.

    Pieces are numbered once and dealt by the hash of their number into
    partitions of about ``per_partition``, so none grows with the input, a hot
    key or a row that repeats. After each round partitions with more
    bins than their bound give the pieces of bins that aren't full to the next
    round; a round that saves no bin ends the exchange. Rows that repeat are pieces of
    their own. sequence_id: round, partition and bin.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    left = scratch.save(pieces.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    done, before = [], None
    added = [("_n", "long"), ("sequence_id", "long"), ("offset", "long"), ("bins", "long"), ("bound", "long"), ("settled", "boolean")]
    schema = ", ".join(f"{n} {t}" for n, t in [*pieces.dtypes, *added])
    for r in range(rounds):
        groups = max(1, -(-left.count() // per_partition))
        dealt = left.select(*pieces.columns, "_n").withColumn("_g", F.pmod(F.xxhash64(F.lit(r), "_n"), F.lit(groups)))
        packed = scratch.save(dealt.groupBy("_g").applyInArrow(_packer(most, r, r == rounds - 1), schema), f"round{r}")
        bins = packed.select("sequence_id").distinct().count()
        if before is not None and bins >= before:  # the exchange saved nothing
            done.append(left)
            break
        done.append(packed.where("settled"))
        left = packed.where("NOT settled")
        before = left.select("sequence_id").distinct().count()
        if not before:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled", "_n")


def _packer(most: int, r: int, last: bool):
    def fit(key: tuple, items: pa.Table) -> pa.Table:
        items = items.drop_columns("_g").sort_by("_n")
        lengths = items["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, most)
        bound = lower_bound(np.bincount(lengths, minlength=most + 1), most)
        fill = np.bincount(bins, weights=lengths, minlength=n)
        settled = np.full(len(bins), True) if n <= bound or last else fill[bins] == most
        sequence = (r << 56) + (key[0].as_py() << 28) + bins
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("bins", np.full(len(bins), n)), ("bound", np.full(len(bins), bound)), ("settled", settled)):
            items = items.append_column(name, pa.array(values))
        return items

    return fit
