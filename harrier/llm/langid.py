"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters with one space for whatever stands
between words. Each language has a model of order 4: discounted counts at the top,
counts of distinct continuations below, interpolated down to the uniform
distribution. A model is kept as arrays sorted by the hash of the n-gram, with
log-probabilities, and arrays of the contexts' back-off weights. The language
with the least cross-entropy per character is chosen; texts that lie farther from
it than its own calibration texts do are flagged as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_broadcast

ORDER = 4
BITS = 16  # a character's share of an n-gram's 64 bits
SPACE = 32
SLICE = 1 << 20  # characters compared at a time
STEPS = 64  # bins of the calibration histograms, to one nat
SHARPNESS = [2.0**k for k in range(-2, 9)]  # candidates for the score's calibration
UNKNOWN = "und"
BROADCAST_LANGUAGES = 100_000
HELD_BACK = 8  # one row in so many calibrates
LENGTH_CLASSES = 40


@lru_cache(maxsize=1 << 17)
def _symbol(code: int) -> int:
    """A letter's number, folded to 16 bits beyond the basic plane; SPACE for all else."""
    if not chr(code).isalpha():
        return SPACE
    return code if code < 1 << BITS else (code * 40503 & 0xFFFF) | 1


_BASIC = None


def symbols(text: str) -> np.ndarray:
    """The letters of the text in lower case, each run of other characters as one space, and a space at the end; empty without a letter."""
    global _BASIC
    if _BASIC is None:
        _BASIC = np.array([_symbol(c) for c in range(1 << BITS)], np.uint16)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if len(codes) and codes.max() >= 1 << BITS:
        kinds, at = np.unique(codes, return_inverse=True)
        out = np.array([_symbol(int(c)) for c in kinds], np.uint16)[at]
    else:
        out = _BASIC[codes]
    out = np.append(out, np.uint16(SPACE))
    blank = out == SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    out = out[keep]
    return out if (out != SPACE).any() else out[:0]


def grams(texts: list[np.ndarray]) -> np.ndarray:
    """The n-gram that ends at each symbol of each text, earlier symbols in higher bits; a text is preceded by spaces."""
    padded = np.concatenate([np.concatenate([np.full(ORDER - 1, SPACE, np.uint16), t]) for t in texts]).astype(np.uint64)
    out = np.zeros(len(padded), np.uint64)
    for k in range(ORDER):
        out[k:] |= padded[: len(padded) - k] << np.uint64(BITS * k)
    ends = np.cumsum([len(t) + ORDER - 1 for t in texts])
    lead = np.ones(len(padded), bool)
    for k in range(ORDER - 1):
        lead[np.concatenate([[0], ends[:-1]]) + k] = False
    return out[lead]


def _sliced(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of about SLICE n-grams: the texts' numbers, where each begins, the n-grams. Long texts come in several groups."""
    numbers, held, size = [], [], 0
    for number, text in texts:
        if not len(text):
            continue
        if len(text) > SLICE:  # each slice begins with the symbols before it, whose own n-grams are dropped
            for a in range(0, len(text), SLICE):
                context = min(a, ORDER - 1)
                yield [number], np.array([0]), grams([text[a - context : a + SLICE]])[context:]
            continue
        numbers.append(number), held.append(text)
        size += len(text)
        if size >= SLICE:
            yield numbers, np.concatenate([[0], np.cumsum([len(t) for t in held])[:-1]]), grams(held)
            numbers, held, size = [], [], 0
    if held:
        yield numbers, np.concatenate([[0], np.cumsum([len(t) for t in held])[:-1]]), grams(held)


def _hashed(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(0x9E3779B97F4A7C15)  # odd, so keys stay apart


class Model:
    """One language: for each order sorted hashes of n-grams with log-probabilities, and of contexts with log back-off weights."""

    def __init__(self, floor: float):
        self.floor, self.grams, self.contexts = floor, {}, {}

    def put(self, order: int, keys: np.ndarray, logs: np.ndarray, contexts: bool) -> None:
        h = _hashed(keys.view(np.uint64))
        by = np.argsort(h)
        (self.contexts if contexts else self.grams)[order] = (h[by], logs[by].astype(np.float32))

    @staticmethod
    def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        h = _hashed(keys)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return table[0][at] == h, table[1][at].astype(np.float64)

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), self.floor)
        known, out = self._find(self.grams.get(order), keys)
        rest = np.flatnonzero(~known)
        if len(rest):
            shorter = keys[rest] & np.uint64((1 << BITS * (order - 1)) - 1)
            met, weight = self._find(self.contexts.get(order), keys[rest] >> np.uint64(BITS))
            out[rest] = np.where(met, weight, 0.0) + self.log_probability(shorter, order - 1)
        return out


def _learning(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, h (a hash of the row) of the rows that may be learnt from; repeated rows have one hash."""
    doc = F.col("doc_id").cast("long")
    h = F.pmod(F.xxhash64(F.lit("learn"), doc, "text"), F.lit(1 << 30))
    return docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), h.alias("h")).where(
        "text IS NOT NULL AND lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 != 1"
    )


def count_grams(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """lang, gram, n: how often each n-gram of the highest order occurs in the texts of a language. A task holds no more than ``most`` distinct ones a language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        def told(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                texts = (symbols(t.as_py()) for t, x in zip(batch.column(0), langs) if x == lang)
                for _, _, g in _sliced(enumerate(texts)):
                    held.setdefault(lang, []).append(np.unique(g, return_counts=True))
                    if len(held[lang]) > 8:
                        held[lang] = [merged(lang)]
                        if len(held[lang][0][0]) > most:
                            yield told(lang, *held.pop(lang)[0])
        for lang in held:
            yield told(lang, *merged(lang))

    return rows.select("text", "lang").mapInArrow(read, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, ord, contexts (boolean), key, log: the interpolated models of counts (lang, gram, n).

    The discount of an order is n1 / (n1 + 2 n2), from the counts of counts of the language; 0.5 where there are none.
    """
    level, tables = counts.withColumnRenamed("n", "c"), {}
    for order in range(ORDER, 0, -1):
        tables[order] = level
        level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("gram")).agg(F.count("*").alias("c"))
    vocabulary = max(1, tables[1].select("gram").distinct().count()) + 1
    out, below = None, None
    for order in range(1, ORDER + 1):
        own = scratch.save(tables[order], f"counts-{order}")
        ones = own.groupBy("lang").agg(F.sum(F.when(F.col("c") == 1, 1.0).otherwise(0.0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1.0).otherwise(0.0)).alias("n2"))
        discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        own = own.join(F.broadcast(ones.select("lang", discount.alias("d"))), "lang")  # a row for each language
        own = own.withColumn("ctx", F.shiftrightunsigned("gram", BITS) if order > 1 else F.lit(0).cast("long"))
        contexts = own.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.first("d") * F.count("*") / F.sum("c")).alias("gamma"))
        each = own.join(contexts, ["lang", "ctx"])
        if below is None:
            each = each.withColumn("lower", F.lit(1.0 / vocabulary))
        else:
            each = each.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1))
            each = each.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        below = scratch.save(each.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")), f"order-{order}")
        both = below.select("lang", F.lit(order).alias("ord"), F.lit(False).alias("contexts"), F.col("gram").alias("key"), F.log("p").alias("log")).unionByName(
            contexts.select("lang", F.lit(order).alias("ord"), F.lit(True).alias("contexts"), F.col("ctx").alias("key"), F.log("gamma").alias("log"))
        )
        out = both if out is None else out.unionByName(both)
    return scratch.save(out.withColumn("floor", F.lit(-float(np.log(vocabulary)))), "models")


def sizes_by_language(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, chars (of the rows to fit on), held (rows held back for the calibration)."""
    back = F.col("h") % HELD_BACK == 0
    sizes = _learning(docs).groupBy("lang").agg(F.sum(F.when(~back, F.length("text")).otherwise(0)).alias("chars"), F.count(F.when(back, 1)).alias("held"))
    return scratch.save(sizes, "sizes")


def train(docs: DataFrame, sizes: DataFrame, scratch: Scratch, sample_chars: int = 8_000_000, most_grams: int = 4_000_000) -> dict[str, Model]:
    """{language: model} from the rows that may be learnt from.

    Models are fitted on a sample by the hash of the row, of about
    ``sample_chars`` characters a language, and all models together hold at most
    ``most_grams`` n-grams of the highest order, a share for each language (about 24
    bytes each with their lower orders): where there are more, a language's rarest counts are left out.
    """
    drawn = _learning(docs).where(F.col("h") % HELD_BACK != 0).join(bounded_broadcast(sizes, sizes.count(), BROADCAST_LANGUAGES), "lang")
    drawn = drawn.where(F.col("h") < (1 << 30) * F.lit(float(sample_chars)) / F.greatest("chars", F.lit(1)))
    counts = scratch.save(count_grams(drawn), "counts")
    spread = counts.groupBy("lang", F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy("lang", F.desc("n"))
    held = spread.collect()  # 65,536 rows a language at most
    share, least, sums = most_grams // max(1, len({r.lang for r in held})), {}, {}
    for r in held:
        sums[r.lang] = sums.get(r.lang, 0) + r["count"]
        if sums[r.lang] <= share:
            least[r.lang] = r.n
    if any(n > share for n in sums.values()):
        keep = counts.sparkSession.createDataFrame([(x, least.get(x, 1 << 62)) for x in sums], "lang string, least long")
        counts = counts.join(bounded_broadcast(keep, len(sums), BROADCAST_LANGUAGES), "lang").where("n >= least").drop("least")
    told = kneser_ney(counts, scratch).toArrow()
    langs, models = told.column("lang").to_numpy(zero_copy_only=False), {}
    order, contexts, key, log = (told.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "contexts", "key", "log"))
    for lang in sorted(set(langs)):
        models[lang] = Model(float(told.column("floor")[0].as_py()))
        for k in range(1, ORDER + 1):
            for c in (False, True):
                here = (langs == lang) & (order == k) & (contexts == c)
                models[lang].put(k, key[here].astype(np.int64), log[here], c)
    return models


def cross_entropies(docs: DataFrame, models: dict[str, Model], *keep: str) -> DataFrame:
    """The kept columns, n_symbols and h, an array with each language's cross-entropy in nats a symbol (null without a letter); texts are read whole."""
    shared, langs = docs.sparkSession.sparkContext.broadcast(models), sorted(models)
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = T.StructType([*fields, T.StructField("n_symbols", T.LongType()), T.StructField("h", T.ArrayType(T.DoubleType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = np.zeros((len(langs), batch.num_rows)), np.zeros(batch.num_rows, np.int64)

            def texts():
                for k, t in enumerate(batch.column("_text")):
                    s = symbols(t.as_py() or "")
                    n[k] = len(s)
                    yield k, s

            for numbers, starts, g in _sliced(texts()):
                kinds, at = np.unique(g, return_inverse=True)
                for x, lang in enumerate(langs):
                    sums[x, numbers] -= np.add.reduceat(shared.value[lang].log_probability(kinds)[at], starts)
            found = (sums / np.maximum(n, 1)).T.tolist()
            arrays = [batch.column(c.name) for c in fields] + [pa.array(n), pa.array([h if k else None for h, k in zip(found, n)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(c.name for c in fields), "n_symbols", "h"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(read, schema)


def _length_class(n):
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def calibrate(docs: DataFrame, sizes: DataFrame, models: dict[str, Model], quantile: float = 0.995, sample_rows: int = 200_000) -> tuple[dict, float]:
    """({(language, length class): greatest cross-entropy of its own texts}, sharpness of the score) from rows held back in training.

    Length classes are powers of two of the symbols. A class's limit is the conformal
    quantile of the entropies of the language's own texts in it, from a histogram; where it
    has fewer texts than that needs (199 for 0.995), those of the shorter
    classes, which vary more, are added; where these don't do either, there is no limit. The sharpness is that
    of SHARPNESS which makes the labels likeliest. About ``sample_rows`` of the rows held back are read, by their hash.
    """
    n = sizes.agg(F.sum("held").alias("n")).first().n or 0
    rows = _learning(docs).where(F.col("h") % HELD_BACK == 0).where(F.col("h") < int((1 << 30) * min(1.0, sample_rows / max(1, n))))
    langs = sorted(models)
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    own = cross_entropies(rows, models, "lang").where("h IS NOT NULL").withColumn("own", F.when(place >= 0, F.get("h", place))).where("own IS NOT NULL")
    weight = [F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(s * (F.col("own") - x))) for s in SHARPNESS]  # noqa: B023
    loss = [F.sum(F.log(w)).alias(f"s{k}") for k, w in enumerate(weight)]
    # entropies lie under the uniform distribution's by and large, so bins are few
    found = own.groupBy("lang", _length_class("n_symbols").alias("size"), F.floor(F.col("own") * STEPS).alias("bin")).agg(F.count("*").alias("n"), *loss).collect()
    limits = {}
    for lang in langs:
        for size in range(LENGTH_CLASSES):
            pool: list[tuple[int, int]] = []
            for shorter in range(size, -1, -1):
                pool += [(r.bin, r.n) for r in found if (r.lang, r.size) == (lang, shorter)]
                rank = math.ceil((sum(k for _, k in pool) + 1) * quantile)
                if rank <= sum(k for _, k in pool):
                    pool.sort()
                    reached = np.cumsum([k for _, k in pool])
                    limits[lang, size] = (pool[int(np.searchsorted(reached, rank))][0] + 1) / STEPS
                    break
    total = [sum(r[f"s{k}"] for r in found) for k in range(len(SHARPNESS))]
    return limits, SHARPNESS[int(np.argmin(total))]


def identify(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cross_entropy (nats a symbol), rejected.

    docs: doc_id, text, lang; other columns are ignored. Learnt are the rows
    with text and lang whose crc32(doc_id as text) % 3 is not 1 (``held_out``
    is that it is; false for a null doc_id, from which nothing is learnt). A
    prediction reads nothing but the text, all of it. lang_pred is ``und``,
    with score 0, for null texts, texts without a letter, and where nothing could be learnt.

    score is a probability: the soft maximum over the languages of the negative cross-entropy,
    with the sharpness of the calibration. rejected says that the text is farther from
    the language than the calibration's limit for texts of its length; where there is none, it isn't rejected. Ties go to the least name.

    The models are broadcast, bounded by ``most_grams``. Scoring has no shuffle; a task
    holds an Arrow batch, and 15 bytes a character of the text at hand.
    """
    scratch = scratch or Scratch(docs.sparkSession, "langid")
    calibration = {k: options.pop(k) for k in ("quantile", "sample_rows") if k in options}
    sizes = sizes_by_language(docs, scratch)
    models = train(docs, sizes, scratch, **options)
    langs = sorted(models)
    doc = F.col("doc_id").cast("long")
    out = docs.select(doc.alias("doc_id"), F.coalesce(F.crc32(doc.cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "text")
    if not models:
        return out.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    limits, sharpness = calibrate(docs, sizes, models, **calibration)
    scored = cross_entropies(out, models, "doc_id", "held_out").withColumn("best", F.array_min("h"))
    named = F.get(F.array(*map(F.lit, langs)), F.array_position("h", F.col("best")).cast("int") - 1)
    score = 1 / F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(sharpness * (F.col("best") - x)))
    table = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.array(*(F.lit(limits.get((lang, k))).cast("double") for k in range(LENGTH_CLASSES))))))
    scored = scored.withColumn("lang_pred", F.coalesce(named, F.lit(UNKNOWN)))
    limit = F.get(F.element_at(table, F.col("lang_pred")), _length_class("n_symbols"))
    rejected = F.col("h").isNull() | F.coalesce(F.col("best") > limit, F.lit(False))
    return scored.select("doc_id", "held_out", "lang_pred", F.coalesce(score, F.lit(0.0)).alias("score"), F.col("best").alias("cross_entropy"), rejected.alias("rejected"))
