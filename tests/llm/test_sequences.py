"""Periodic runs, language identification and conversation repair, each against a plain version."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_llm import corpus, frame

from harrier.llm import langid, repair, runs
from harrier.llm.common import Scratch

# ---- periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    size, kinds, w = rng.randint(0, rng.choice([12, 30, 100, 300])), rng.choice([1, 2, 3, 5, 30]), []
    while len(w) < size:
        if w and rng.random() < 0.5:
            p = rng.randint(1, min(len(w), rng.choice([3, 8, 40])))
            a = rng.randrange(len(w) - p + 1)
            w += w[a : a + p] * rng.randint(1, 7)
        else:
            w += [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 5))]
    return w


def test_runs_of_words():
    rng = random.Random(3)
    for _ in range(1500):
        w = repetitive(rng)
        assert runs.text_runs(w) == plain_runs(w)
        ids = [int(x) for x in w]  # without leaving stretches out first
        assert sorted(((a, b - a, p) for (a, b), p in runs.stretch_runs(ids).items()), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_factors():
    rng = random.Random(4)
    for _ in range(300):
        s = [int(x) for x in repetitive(rng)]
        at = 0
        for a, n, earlier in runs.factors(s):
            assert a == at
            longest = max((k for b in range(a) for k in range(len(s) - a + 1) if s[b : b + k] == s[a : a + k]), default=0)
            assert n == max(1, longest) and (earlier == -1) == (longest == 0)
            assert longest == 0 or (earlier < a and s[earlier : earlier + n] == s[a : a + n])
            at += n
        assert at == len(s)


def plain_row(doc, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    top = min(found, key=lambda r: (-math.floor(10**9 * r[1] / r[2]), r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = "".join(f"{s},{k},{q}\n" for s, k, q in found).encode()
    return (len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha(told), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    docs = corpus(9, 120)
    docs |= {1000: "x " * 40, 1001: "a b " * 3, 1002: "a b " * 4, 1003: "a b " * 9, 1004: "q r s t " * 2000 + "end"}
    found = runs.periodic_runs(runs.with_planted_repeats(frame(spark, docs)))
    got = {r[0]: tuple(r)[1:] for r in runs.run_digests(found).collect()}
    assert got == {d: plain_row(d, t) for d, t in docs.items()}
    assert sum(r[0] > 0 for r in got.values()) > 8
    kept = {r.doc_id: r.collapsed for r in runs.periodic_runs(frame(spark, docs)).collect()}
    assert kept[1000] == "x" and kept[1002] == "a b" and kept[1004] == "q r s t end" and kept[120] == "" and kept[121] == ""


def test_periodic_runs_without_rows_and_ids(spark):
    odd = spark.createDataFrame([(None, "z " * 10), (None, None), (5, "z " * 10), (5, "z " * 10)], "doc_id long, text string")
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    assert rows(runs.run_digests(runs.periodic_runs(runs.with_planted_repeats(odd.where("doc_id IS NULL")))).select("n_runs")) == [(0,), (1,)]
    assert runs.periodic_runs(odd.where("doc_id = 5")).count() == 2
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, least=4)


# ---- language identification


def plain_model(texts, order=langid.ORDER):
    """{n-gram of symbols: probability} at the highest order, by the textbook's recursion."""
    count = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [langid.SPACE] * (order - 1) + [int(x) for x in langid.symbols(t)]
        count[order].update(tuple(s[i - order : i]) for i in range(order, len(s) + 1))
    for k in range(order - 1, 0, -1):
        count[k].update(g[1:] for g in count[k + 1])
    size = len(count[1]) + 1

    def p(g):
        if not g:
            return 1 / size
        level = count[len(g)]
        n1, n2 = (sum(c == x for c in level.values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {h: c for h, c in level.items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    return p, [g[0] for g in count[1]]


def test_model_is_interpolated_kneser_ney(spark):
    texts = ["the cat sat on the mat", "That hat, that cat!", "a théâtre 42 ünder"]
    counts = langid.count_grams(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    told = langid.kneser_ney(counts, Scratch(spark, "kn")).collect()
    model = langid.Model(told[0].floor)
    for k in range(1, langid.ORDER + 1):
        for c in (False, True):
            own = [r for r in told if (r.ord, r.contexts) == (k, c)]
            model.put(k, np.array([r.key for r in own], np.int64), np.array([r.log for r in own]), c)
    p, alphabet = plain_model(texts)
    rng = random.Random(0)
    for g in [*(tuple(rng.choice(alphabet) for _ in range(4)) for _ in range(200)), tuple(langid.symbols("that").tolist()[:4])]:
        key = np.array([sum(x << 16 * (3 - i) for i, x in enumerate(g))], np.uint64)
        assert model.log_probability(key)[0] == pytest.approx(math.log(p(g)), rel=1e-5)
    for context in ("the", "zzz"):
        total = sum(p((*map(ord, context), x)) for x in alphabet)
        assert total + p((*map(ord, context), 0x4E00)) == pytest.approx(1.0)  # the alphabet, and one place for all else


def test_slices_do_not_matter(monkeypatch):
    text = langid.symbols("Wörter, und noch mehr Wörter! " * 50)
    whole = langid.grams([text])
    monkeypatch.setattr(langid, "SLICE", 100)
    parts = list(langid._sliced(iter([(0, text), (1, text[:30]), (2, text[:0])])))
    assert np.array_equal(np.concatenate([g for k, _, g in parts if k == [0]]), whole)
    assert np.array_equal(parts[-1][2], whole[:30]) and parts[-1][0] == [1]
    assert langid.symbols("12 !?\n").size == 0 and langid.symbols("").size == 0
    assert langid.symbols("A--b \U00020000").tolist() == [97, 32, 98, 32, langid._symbol(0x20000), 32]


def speech(rng, lang, n):
    parts = {"en": ["th", "e", "ing", "and", "wh", "sh"], "de": ["sch", "ein", "ung", "ü", "ß", "er"], "el": ["αι", "ος", "κ", "θη", "ς"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(8)
    docs = [(d, speech(rng, lang := rng.choice(["en", "en", "de", "el"]), rng.randint(4, 60)), lang if d % 11 else None) for d in range(900)]
    truth = {d: ("en" if any(c in t for c in ("th", "ing", "wh")) else None) for d, t, _ in docs}
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "123 !!", "de"), (9004, speech(rng, "en", 20_000), "en"), (None, "thething", "el"), (9005, "ыфвапро " * 60, None), (9006, speech(rng, "de", 30), None)]
    df = spark.createDataFrame(docs + odd + [odd[-1]], "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("h", "best", "score", "n_symbols", "_text", "gram", "held_out")})
    found = langid.identify(df, quantile=0.9).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(docs) + len(odd) + 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    checked = [(r.lang_pred, lang) for d, _, lang in docs if lang and (r := got[d]).held_out]
    assert len(checked) > 200 and sum(a == b for a, b in checked) >= 0.99 * len(checked)
    assert all(got[d].lang_pred == "en" for d, x in truth.items() if x and got[d].held_out)
    assert [got[d].lang_pred for d in (9001, 9002, 9003)] == ["und"] * 3 and all(got[d].score == 0 for d in (9001, 9002, 9003))
    assert got[9004].lang_pred == got[None].lang_pred == "en" and got[9006].lang_pred == "de"
    assert got[9005].lang_pred in ("en", "de", "el") and got[9005].rejected  # a script that no model knows
    assert sum(r.rejected for r in found if r.doc_id is not None and r.doc_id < 9000) < 0.25 * len(docs)
    small = {r.doc_id: r.lang_pred for r in langid.identify(df, most_grams=300).collect()}  # the rarest n-grams go
    assert sum(small[d] == lang for d, _, lang in docs if lang) >= 0.95 * sum(lang is not None for _, _, lang in docs)


def test_languages_of_nothing(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.identify(df.limit(0)).count() == 0
    assert rows(langid.identify(df).select("lang_pred", "score")) == [("und", 0.0), ("und", 0.0)]


# ---- conversation repair

ARCS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def plain_repair(seq):
    """seq: (turn, role, text) in order; every edit string with up to two inserts at a place is tried."""
    seen, faults = set(), []
    for _, role, text in seq:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    best = None
    level = [("", 0, "", ())]  # grammar state, cost, labels, lines
    for k in range(len(seq) + 1):
        wide = list(level)
        for _ in range(2):
            level = [(NEXT[q], c + 3, s + "I", (*r, f"{FULL[NEXT[q]]}:")) for q, c, s, r in level]
            wide += level
        if k == len(seq):
            ends = [(c, s, r) for q, c, s, r in wide if q in ("", "a")]
            best = min(ends)
            break
        _, role, text = seq[k]
        more = 3 if faults[k] == 3 else 0
        level = []
        for q, c, s, r in wide:
            level.append((q, c + 4, s + "D", r))
            if faults[k] not in (1, 2):
                if (q, role[:1]) in ARCS:
                    level.append((ARCS[q, role[:1]], c + more, s + "K", (*r, f"{role}:{text}")))
                level.append((NEXT[q], c + 3 + more, s + "R", (*r, f"{FULL[NEXT[q]]}:{text}")))
        cheapest = {q: min(c for p, c, _, _ in level if p == q) for q in {x[0] for x in level}}
        level = [x for x in level if x[1] <= cheapest[x[0]]]  # costs alone are safe to compare here
    turns = [t for t, _, _ in seq if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(seq)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    if not seq:
        best = (0, "", ())
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def conversations(rng, n):
    out = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "sys", None, "üser", ""])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "  ", "", None, "end. \n", " ", "a:b\nc.", "Yes."])
            out.append((c if c else None, rng.choice([t, t, t, t + 3, None, -t]), role, text))
    return out


def plain_damage(data):
    by = {}
    for c, t, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        by.setdefault(c, []).extend([] if k == 0 else [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in by.items()}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    data = conversations(random.Random(6), 250)
    df = spark.createDataFrame(data, CONVERSATIONS).withColumns({c: F.lit("clash") for c in ("fault", "again", "rest", "after", "_k", "_copy")})
    found = repair.repair(repair.damaged(df)).drop("n_rows")
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {c: plain_repair(seq) for c, seq in plain_damage(data).items()}
    said = {}
    for r in repair.repair(repair.damaged(df), turns=True).orderBy("conv_id", "seq").collect():
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, row in got.items():
        assert hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() == row[-1]


def test_repair_of_nothing_and_of_a_long_conversation(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repair(repair.damaged(empty)).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "x", True)], CONVERSATIONS + ", gone boolean")
    assert rows(repair.repair(gone)) == [(7, 0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    found = repair.repair(long.repartition(5)).first()
    assert (found.cost, found.audit, found.n_rows) == (0, "K" * 30_000, 30_000)


# ---- what earlier operators were found to lack


class Forgetful:
    """Says that turns stand alone, but drops the oldest ones once there are twenty."""

    look_back = 0

    def render(self, turns):
        return "".join(f"[{r}|{t}]" for r, t in (turns if len(turns) < 20 else turns[-10:]))


class Numbering(Forgetful):
    """Says that turns stand alone, but numbers them."""

    def render(self, turns):
        return "".join(f"[{k}{r}|{t}]" for k, (r, t) in enumerate(turns))


def test_a_template_is_not_believed():
    from harrier.llm import chat

    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    for template, rewriting in ((Forgetful(), set(range(19, 40))), (Numbering(), set())):
        spans = chat.conversation_spans(template, turns, template.look_back, 16)
        assert spans == list(chat.turn_spans(template, turns))
        assert {k for k, s in enumerate(spans) if s[3]} == rewriting
    own = chat.MarkedTurns()
    assert chat.conversation_spans(own, turns, 0, 16) == list(chat.turn_spans(own, turns))
    assert chat.conversation_spans(own, [], 0, 16) == []


def test_samples_are_bounded(spark):
    from harrier.llm.common import bounded_sample

    same = spark.range(20_000, numPartitions=8).selectExpr("1 k")
    n = bounded_sample(same, 10_000, "k").count()
    assert 9000 < n <= 12_500
    assert bounded_sample(same.limit(50), 100, "k").count() == 50


def test_rare_links_are_met(spark):
    """Links of 30 among 6,000 vectors, so that few of the queries have one."""
    from harrier.llm import multiindex

    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(k, 5000 + k) for k in range(0, 900, 30)]
    for a, b in pairs:
        side = rng.standard_normal(64)
        side -= side @ x[a] * x[a]
        x[b] = 0.905 * x[a] + math.sqrt(1 - 0.905**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = multiindex.embedding_near_duplicates(df, queries=20).where("n_links > 0").collect()
    assert {r.vec_id for r in found} == {k for p in pairs for k in p}
    none = multiindex.embedding_near_duplicates(df.limit(0))
    assert none.count() == 0


# ---- the pipeline's stages, each against a plain version


def test_pipeline_stages_by_value(spark):
    import brute
    import corpus_pipeline

    docs = corpus(12, 70)
    line = "this line stands in many documents 17"
    for d in range(0, 60, 4):
        docs[d] = (docs[d] or "") + "\n" + line.replace("17", str(d)) + "\nend of " + str(d)
    made = spark.createDataFrame([(d, t, "en", f"s{d % 3}" if d % 10 else None, len(t or "")) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    lined = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, made, "").collect()}
    assert lined == {d: x[2] for d, x in brute.template_lines(docs).items()} and any(lined[d] != docs[d] for d in docs)
    kept = corpus_pipeline.near_dedup(spark, made, "")
    found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert found == {d: (docs[d], len(docs[d] or "")) for d, (_, _, k) in brute.near_duplicates(docs, 5).items() if k} and len(found) < len(docs)
    words = lambda t: brute.WORD.findall((t or "").encode())
    mixed = corpus_pipeline.source_mixing(spark, kept, "").collect()
    size, got, parts = {}, {}, {}
    source = {r.doc_id: r.source for r in kept.collect()}
    for d, (t, _) in found.items():
        size[source[d]] = size.get(source[d], 0) + len(words(t))
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        parts.setdefault(r.doc_id, []).append(words(r.text))
        assert r.n_chars == len(r.text)
    for d, copies in parts.items():
        own = words(found[d][0])
        assert len(copies) <= 2 and sum(c != own for c in copies) <= 1 and all(c == own[: len(c)] for c in copies)
    names = [*sorted(s for s in size if s), None]
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) <= len(names)
    assert all(got[s] <= 2 * size[s] for s in names)
    packed = corpus_pipeline.best_fit_packing(spark, kept, "").collect()
    by_sequence, by_doc = {}, {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert set(by_doc) == set(found)
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    for pieces in by_doc.values():
        end = 0
        for k, (piece, start, n) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, end) and (k == 0 or n == 1024)
            end += n
    assert len(by_sequence) <= 1.3 * sum(r.length for r in packed) / 1024 + 1
