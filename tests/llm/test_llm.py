"""Each operator against its plain version, on texts with copies, edits, nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from harrier.llm import anchors, chat, fingerprints, minhash, mixing, multiindex, packing, quality, suffixes, templates, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    vocabulary = [word() for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(k))
    docs = {i: text(rng.choice([0, 1, 30, 80, 200, 400])) for i in range(n)}
    passage = text(70)
    for i in range(0, n, 4):  # passages, exact copies, edited copies
        docs[i] = docs[i] + " " + passage + " " + text(5)
    for i in range(3, n, 9):
        docs[i] = docs[i - 2]
    for i in range(5, n, 7):
        w = docs[i - 1].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "edit"
        docs[i] = " ".join(w)
    docs |= {n: None, n + 1: "", n + 2: " \t\n ", n + 3: "a" * 500, n + 4: "x y " * 300, n + 5: text(9000), n + 6: "one"}
    docs[n + 7] = docs[n + 5]
    return docs


def frame(spark, docs, extra=True):
    data = [(d, t, "en" if d % 3 else None, f"s{d % 2}" if d % 5 else None, len(t or "")) for d, t in docs.items()]
    df = spark.createDataFrame(data, DOCS)
    clashing = ("size", "n", "h1", "kept", "a", "c", "leaf", "tokens", "component", "source_size", "taken", "n_removed", "g", "x1", "_words", "spans", "doc")
    return df.withColumns({c: F.lit("clash") for c in clashing}) if extra else df


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_repeated_bytes(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeated_bytes(frame(spark, docs)).collect()}
    assert got == brute.repeated_bytes(docs)
    kept = suffixes.remove_repeated_bytes(frame(spark, docs), texts=True)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept.collect())


def test_repeated_bytes_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 3)
    monkeypatch.setattr(anchors, "BROADCAST_IDS", 0)
    some = corpus(7, 30)
    assert {r[0]: tuple(r)[1:] for r in suffixes.remove_repeated_bytes(frame(spark, some)).collect()} == brute.repeated_bytes(some)


def test_repeated_words(spark, docs):
    want = brute.repeated_words(docs)
    for batches in (1, 3, 5):  # five batches compact the runs
        got = {r[0]: tuple(r)[1:] for r in fingerprints.remove_repeated_words(frame(spark, docs), batches=batches).collect()}
        assert got == want


def test_fingerprint_index_opened_again(spark, docs, tmp_path):
    ids, found = sorted(docs), []
    root = (tmp_path / "index").as_uri()
    for at in range(0, len(ids), 14):
        part = ids[at : at + 14]
        session = spark.newSession()  # each batch finds the index as the one before left it
        index = fingerprints.FingerprintIndex(fingerprints.Scratch(session, "again"), root, fan=2)
        known = anchors.encoded(frame(session, docs)).where(F.col("doc_id") <= part[-1])
        batch = known.where(F.col("doc_id") >= part[0])
        found.append(index.add(batch, known))
        with pytest.raises(ValueError):
            index.add(batch, known)
        run = index.run(index.content["runs"][0]["name"])
        plan = run.join(batch.selectExpr("doc_id AS a").hint("merge"), "a", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the batch is shuffled
        index.close()
    assert len(found) == 5 and len(index.content["runs"]) == 2  # five runs: one of four, one of one
    spans = [r for df in found for r in anchors.merged(df, 50).collect()]
    got = {r.doc: sum(y - x for x, y in zip(r.spans[::2], r.spans[1::2])) for r in spans}
    assert got == {d: v[1] for d, v in brute.repeated_words(docs).items() if v[1]}
    with pytest.raises(ValueError):
        fingerprints.FingerprintIndex(fingerprints.Scratch(spark, "again"), root, window=40)



def test_no_rows_and_no_ids(spark):
    none = frame(spark, {}, extra=False)
    odd = spark.createDataFrame([(None, "x " * 200, None, None, None), (None, None, None, None, None), (1, "x " * 200, None, None, None)], DOCS)
    for op in (suffixes.remove_repeated_bytes, fingerprints.remove_repeated_words, minhash.near_duplicates, quality.quality_rules, templates.drop_recurring_lines, mixing.mix_sources, lambda d: packing.pack(packing.tokenize(d))):
        assert op(none).count() == 0
        assert op(odd).count() == 3
    assert rows(suffixes.remove_repeated_bytes(odd).where("doc_id IS NULL").select("n_removed")) == [(0,), (0,)]
    assert rows(minhash.near_duplicates(odd).where("doc_id IS NULL").select("component_id", "kept")) == [(None, True), (None, True)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs), width).collect()}
    assert got == brute.near_duplicates(docs, width)


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for d in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 22)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        docs[d] = " ".join(w)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs), 2, most=64).collect()}
    assert got == {d: c for d, (_, c, _) in brute.near_duplicates(docs).items()}


def test_near_duplicates_whose_partners_are_taken(spark):
    """Longer versions come first and take the middle text; the shortest one is similar to that alone."""
    docs, want, families = {}, {}, 150
    for f in range(families):
        w = [f"f{f}w{i}" for i in range(801)]
        texts = [*(w + [f"f{f}v{v}x{i}" for i in range(200)] for v in range(3)), w, w[:641]]
        for k, t in enumerate(texts):
            docs[k * families + f], want[k * families + f] = " ".join(t), f
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs, extra=False), 2).collect()}
    assert got == want


def test_near_duplicates_in_crowded_regions(spark):
    """Texts of similarity 0.75 fill the regions; each has one partner, of similarity 0.8."""
    core, docs, want = [f"c{i}" for i in range(600)], {}, {}
    for k in range(150):
        text = core + [f"k{k}x{i}" for i in range(101)]
        docs |= {k: " ".join(text), 1000 - k: " ".join(text + [f"k{k}y{i}" for i in range(175)])}
        want |= {k: k, 1000 - k: k}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs, extra=False), 2, most=4).collect()}
    assert got == want


def test_labels_of_long_texts():
    """Equal labels mean equal minima at any size: different texts of 120,000 shingles have next to none in common."""
    sets = [minhash.shingle_set(" ".join(f"t{t}w{i}" for i in range(120_001)).encode(), 2) for t in range(4)]
    labels = [minhash.signer(96)(s) for s in sets]
    assert all(len(s) == 120_000 for s in sets)
    assert all((x == y).mean() < 0.05 for i, x in enumerate(labels) for y in labels[:i])
    whole = np.unique(np.concatenate([sets[0], sets[1][:20_000]]))  # similarity 6/7
    assert 0.7 < (minhash.signer(96)(whole) == labels[0]).mean() < 0.97


def test_base_statistics(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in quality.quality_rules(frame(spark, docs)).drop("d2", "kept").collect()}
    assert got == {d: brute.base_statistics(t) for d, t in docs.items()}


def test_outliers(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    docs = {d: " ".join(rng.choice(words) for _ in range(60)) for d in range(300)}
    junk = {d: " ".join(w + "***%%%" for w in docs[d].split()) for d in range(0, 300, 20)}
    stutter = {d: " ".join(w for w in docs[d].split()[:10] for _ in range(7)) for d in range(1, 300, 30)}
    lines = {d: "\n".join(" ".join(docs[d].split()[k : k + 5]) for k in (0, 5, 10, 0, 5, 10, 0, 5, 10, 15)) for d in range(2, 300, 40)}
    phrases = {d: " ".join(docs[d].split() + docs[d + 1].split()[:30] + docs[d].split()[:14]) for d in range(3, 300, 50)}
    odd = {*junk, *stutter, *lines, *phrases}
    got = {r.doc_id: r.kept for r in quality.quality_rules(frame(spark, docs | junk | stutter | lines | phrases)).collect()}
    assert {d for d in got if not got[d]} == odd


def test_minimum_covariance_determinant(spark):
    """The distances are those that the same steps give in NumPy."""
    docs = corpus(4, 200)
    df = quality.quality_rules(frame(spark, docs), least_rows=1 << 30, draws=0)  # all rows in one group
    got = {r.doc_id: r.d2 for r in df.where("NOT base_failed").collect()}
    stats = quality.base_statistics(frame(spark, docs), "doc_id").withColumns(quality.transformed()).where("NOT base_failed")
    names = list(quality.FLOORS)
    data = {r.doc_id: [r[n] for n in names] for r in stats.collect()}
    ids = sorted(data)
    x, floors = np.array([data[d] for d in ids]), np.array(list(quality.FLOORS.values()))

    def nearest(d2):
        bins = np.floor(64 * np.log2(np.maximum(d2, 1e-9)))
        order = np.sort(bins)
        return bins <= order[int(np.ceil(0.6 * len(order))) - 1]

    def distance(sub, factor):
        m = sub.mean(0)
        c = factor * ((sub[:, :, None] * sub[:, None, :]).mean(0) - np.outer(m, m))
        low = np.zeros_like(c)
        for i in range(len(m)):
            for j in range(i):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
            low[i, i] = np.sqrt(max(max(c[i, i], 0) - low[i, :i] @ low[i, :i], 0) + floors[i] ** 2)
        return (np.linalg.solve(low, (x - m).T) ** 2).sum(0)

    def covariance(sub, factor):
        m = sub.mean(0)
        c = factor * ((sub[:, :, None] * sub[:, None, :]).mean(0) - np.outer(m, m))
        return c + np.diag(floors**2)

    log_det = lambda near: np.linalg.slogdet(covariance(x[near], 1))[1]
    near = nearest((((x - np.sort(x, axis=0)[(len(x) - 1) // 2]) / floors) ** 2).sum(1))
    while log_det(step := nearest(distance(x[near], 1))) < log_det(near) - quality.LEAST_FALL:
        near = step
    near = nearest(distance(x[near], 1))
    factor = 0.6 / quality.chi_square(quality.chi_square_quantile(0.6, 5), 7)
    assert np.allclose([got[d] for d in ids], distance(x[near], factor), rtol=1e-6, atol=1e-9)

    # more starts: the determinant does not rise
    data = spark.createDataFrame([("[]", *map(float, v)) for v in x], ", ".join(["g string", *(f"{n} double" for n in names)]))
    scratch = quality.Scratch(spark, "test")
    ends = [np.array(quality._best_half(data, scratch, 0.6, draws).select(*names).collect()) for draws in (0, 4)]
    assert np.linalg.slogdet(covariance(ends[1], 1))[1] <= np.linalg.slogdet(covariance(ends[0], 1))[1] + 0.05


def test_chi_square():
    """Tabled quantiles."""
    assert [round(quality.chi_square_quantile(p, k), 3) for p, k in ((0.999, 5), (0.95, 1), (0.5, 10))] == [20.515, 3.841, 9.342]


def test_templates(spark):
    rng = random.Random(9)
    docs = {}
    for d in range(40):
        own = [" ".join(f"w{'abcdefgh'[rng.randrange(8)]}{'xyz'[rng.randrange(3)]}" for _ in range(rng.randint(2, 8))) for _ in range(6)]
        docs[d] = "\n".join([*own[:3], f"Page {d} of the report by {'Ann' if d % 2 else 'Bob'} today", *own[3:], "All rights reserved."])
    docs |= {40: None, 41: "", 42: "All rights reserved.", 43: "\n\n"}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in templates.drop_recurring_lines(frame(spark, docs)).collect()}
    assert got == brute.template_lines(docs)
    assert got[0][1] >= 2 and got[42] == (1, 1, "")
    half = templates.drop_recurring_lines(frame(spark, docs), most_share=0.5)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in half.collect()} == brute.template_lines(docs, most_share=0.5)


def test_packing(spark, docs):
    pieces = packing.tokenize(frame(spark, docs), ids=True)
    packed = packing.pack(pieces, per_partition=20).collect()
    encoder = packing.ChunkEncoder()
    by_doc, by_bin = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, t in docs.items():
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [i for p in parts for i in p.ids] == [*encoder.whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert all(p.length == 1024 for p in parts[1:]) and parts[0].length <= 1024
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("text", ["a  b\n\n c\t\td  e\x1c f g 　 h it's I'LL 123 456", "  lead trail  ", "\n", "", "é́ 日本語 ١٢٣ 😀😀  ", "a <|endoftext|> b", " x", "x \n y"])
def test_token_ids(text):
    encoder = packing.ChunkEncoder()
    assert list(np.frombuffer(encoder(text), "<u4")) == encoder.whole.encode(text, add_special_tokens=False).ids


def fewest_bins(sizes, most):
    """The optimum, by trying all places of each item."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[k]}):
            i = rooms.index(room)
            place(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, most - sizes[k]])

    place(0, [])
    return best[0]


def test_packings_against_the_optimum():
    """A bound never exceeds the optimum, so a certified packing is one; best-fit decreasing takes 11/9 of it and 6/9 bins more at most."""
    rng, certified = np.random.default_rng(1), 0
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 1025, rng.integers(1, 9)) if rng.random() < 0.5 else rng.choice([200, 340, 350, 500, 520, 700], 8))[::-1]
        optimum, n = fewest_bins(sizes.tolist(), 1024), packing.best_fit_decreasing(sizes, 1024)[2]
        bound = packing.lower_bound(np.bincount(sizes, minlength=1025), 1024)
        assert bound <= optimum <= n <= 11 / 9 * optimum + 6 / 9
        certified += n == bound
    assert certified >= 40


def test_packing_of_rows_that_repeat(spark):
    """One piece many times is dealt over the partitions, and the exchange makes no more bins than the optimum of one partition allows."""
    pieces = spark.range(700).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "IF(id < 600, 500L, 24L) AS length", "7L AS ids_crc32")
    packed = packing.pack(pieces, per_partition=100).collect()
    assert len(packed) == 700 and all(r.bound <= r.bins for r in packed)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())
    assert 300 <= len(bins) <= 305


def test_bounds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 1025, rng.integers(1, 60))
        n = packing.best_fit_decreasing(sizes, 1024)[2]
        assert packing.lower_bound(np.bincount(sizes, minlength=1025), 1024) <= n
    assert packing.lower_bound(np.bincount([600] * 5 + [500] * 2, minlength=1025), 1024) == 6


def test_mixing(spark, docs):
    df = frame(spark, docs)
    out = mixing.mix_sources(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in out} == again
    sizes = {d: len(brute.WORD.findall((t or "").encode())) for d, t in docs.items()}
    assert {r.doc_id: r["size"] for r in out} == sizes
    total, taken, target = {}, {}, {}
    for r in out:
        total[r.source] = total.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted((s for s in total if s is not None)) + [None]
    weights, left, fixed = dict(zip(names, [3, 1, 2])), 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (left - sum(fixed.values())) / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > 2 * total[s]]
        if not over:
            break
        fixed |= {s: 2.0 * total[s] for s in over}
    for s in names:
        assert abs(target[s] - fixed.get(s, level * weights[s])) < 1e-6 and abs(taken[s] - target[s]) < 1
    nameless = spark.createDataFrame([(None, f"w{i} " * (i % 9), "en", "s", 0) for i in range(3000)], DOCS)
    mixed = mixing.mix_sources(nameless, rows_per_bucket=16, keep=["doc_id"]).collect()
    assert abs(sum(r.taken for r in mixed) - mixed[0].target) < 1 and any(r.taken > r["size"] for r in mixed)
    words = mixing.materialize(mixing.mix_sources(df), ["doc_id", "text"]).select(F.sum(F.size(F.array_remove(F.split("text", r"\s+"), "")))).first()[0]
    assert words == sum(taken.values())


def test_archives(spark, tmp_path):
    html = {i: f"<p>page {i % 7}</p>" * (i % 5 + 1) for i in range(60)} | {60: None, 61: "", 62: "é" * 100_000}
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y" if i % 2 else None, h) for i, h in html.items()], "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    folder, manifest = warc.archive_pages(pages, file_bytes=20_000)
    got = warc.read_archives(folder, manifest, payloads=True).collect()
    assert manifest.count() > 1 and len(got) == len(html)
    same = {}
    for i, h in html.items():
        same.setdefault(h or "", []).append(i)
    for r in got:
        h = html[r.page_id] or ""
        first = max(same[h])
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(h.encode()), "response" if r.page_id == first else "revisit", None if r.page_id == first else first)
        assert r.payload is None if r.refers_to is not None else bytes(r.payload) == h.encode()
    folder, manifest = warc.archive_pages(pages, least_bytes=50)
    assert {r.page_id for r in warc.read_archives(folder, manifest).where("record_type = 'revisit'").collect()} == {i for h, p in same.items() if len(h.encode()) >= 50 for i in p if i != max(p)}
    assert warc.read_archives(*warc.archive_pages(pages.limit(0))).count() == 0


class LastTurnOnly:
    """A template that drops earlier assistant texts once the user goes on: it rewrites history."""

    def render(self, turns):
        last = max((i for i, t in enumerate(turns) if t[0] == "user"), default=-1)
        return "".join(f"[{r}]{t if r == 'user' or i > last else '...'}\n" for i, (r, t) in enumerate(turns))


def test_chat(spark):
    talk = [("system", "be <|im_end|> \\ good"), ("user", "A"), ("assistant", "<|im_start|>x\\n"), ("user", None), ("assistant", ""), ("assistant", "B\n")]
    data = [(c, k, r, t) for c in range(3) for k, (r, t) in enumerate(talk)] + [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(50)] + [(None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    unbounded = chat.MarkedTurns()
    unbounded.look_back = None
    for template, step in ((None, 1), (None, 4), (None, 256), (unbounded, 4)):
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, template, step)).collect()}
        for c in {x[0] for x in data}:
            turns = [(r or "", t or "") for d, _, r, t in data if d == c]
            loss = "".join(t for r, t in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert got[c].formatted_chars == len(chat.MarkedTurns().render(turns))
    flags = [x[3] for x in chat.turn_spans(LastTurnOnly(), [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])]
    assert flags == [False, False, True, False]


def test_chat_of_many_turns(spark):
    class Numbered:
        """A template that looks back over the whole conversation: each turn tells how many turns of its role came before, and the 300th rewrites the first."""

        def render(self, turns):
            seen, out = {}, []
            for r, t in turns:
                out.append(f"[{r}{seen.get(r, 0)}]{t}\n")
                seen[r] = seen.get(r, 0) + 1
            return "".join(["(long)", *out[1:]] if len(turns) >= 300 else out)

    talk = [("assistant" if k % 2 else "user", f"t{k}") for k in range(310)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df, Numbered()).orderBy("seq").collect()
    before = ""
    for k, r in enumerate(got):
        now = Numbered().render(talk[: k + 1])
        assert r.rewrites == (not now.startswith(before)) == (k == 299)
        if not r.rewrites:
            assert before + r.piece == now
            assert (r.loss_start >= 0) == (k % 2 == 1) and (k % 2 == 0 or r.piece[r.loss_start : r.loss_end] == f"t{k}")
        before = now


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    x = np.concatenate([centres[rng.integers(0, 25, 300)] + rng.normal(size=(300, 16)) * 0.25, rng.normal(size=(200, 16))]).astype("float32").astype(float)
    x[10] = x[11] = x[12]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumns({"rep": F.lit("clash"), "n": F.lit(1)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.embedding_near_duplicates(df, codewords=6, block=50).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    c = brute.components(range(len(x)), zip(*map(list, np.nonzero(link))))
    recall = sum(got[i][0] for i in range(len(x))) / link.sum()
    assert recall >= 0.99
    assert got == {i: (int(link[i].sum()), c[i], c[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, _ in odd if i} | {None: (0, None, True)}


def test_recall_with_a_small_sample(spark):
    """Pairs of near-duplicates, few of which a sample holds whole: the visited cells come from queries against all vectors."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2000, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multiindex.embedding_near_duplicates(df, codewords=8, sample=200, queries=300, block=500).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found, want = np.array([got[i] for i in range(len(x))]), link.sum(1)
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() and want.sum() > 3000


def test_multi_sequence_order():
    rng = np.random.default_rng(8)
    index = multiindex.MultiIndex(rng.normal(size=(300, 10)), 7)
    x = rng.normal(size=(40, 10))
    first, second = index.distances(x)
    every = (first[:, :, None] + second[:, None, :]).reshape(len(x), -1)
    for visits in (1, 5, 20, 49):
        index.visits = visits
        seen = index.visited(x)
        assert np.allclose(np.take_along_axis(every, seen, 1), np.sort(every, axis=1)[:, :visits])
        assert (index.ranks(x, seen[:, -1]) == visits).all() and (seen[:, 0] == index.cells(x)).all()


def test_pipeline(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best-fit packing":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() and (name in ("source mixing", "best-fit packing") or docs.count() <= n)


def test_pipeline_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    good, bad = [text(60) for _ in range(4)], ["too short", "x"]
    near = good[0].rsplit(" ", 2)[0] + " other end"
    data = [(9, good[0]), (3, near), (3, near), (3, good[1]), (3, bad[0]), (None, good[2]), (None, good[0]), (None, bad[1]), (5, bad[1]), (7, good[3]), (7, good[3])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], DOCS)
    order = lambda pairs: sorted(pairs, key=str)
    passed = corpus_pipeline.quality_rules(spark, docs, "")
    want = [(d, t) for d, t in data if t not in bad]
    assert order((r.doc_id, r.text) for r in passed.collect()) == order(want)
    rows_left = corpus_pipeline.near_dedup(spark, docs.where(F.length("text") > 20), "")
    assert order((r.doc_id, r.text) for r in rows_left.collect()) == order([(3, near), (3, good[1]), (None, good[2]), (None, good[0]), (7, good[3])])
