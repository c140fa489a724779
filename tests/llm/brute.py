"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeated_bytes(docs):
    """docs: {doc_id: text}; {doc_id: (n, removed, spans, kept sha256)}."""
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def repeated_words(docs):
    first, out = {}, {}
    for d in sorted(docs):
        w = WORD.findall((docs[d] or "").encode())
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), d) < d:
                gone[s : s + 50] = [True] * 50
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingles(text, width):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(ids, links):
    lead = {i: i for i in ids}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        lead[b] = a
    return {i: root(i) for i in ids}


def near_duplicates(docs, width=2, percent=80):
    sets = {d: shingles(t, width) for d, t in docs.items()}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    c = components(sets, links)
    return {d: (len(sets[d]), c[d], c[d] == d) for d in docs}


def base_statistics(text):
    text = text or ""
    w = [x.decode() for x in WORD.findall(text.encode())]
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def template_lines(docs, least=10, depth=3, constant=0.5, most_share=1.0):
    """docs: {doc_id: text}; {doc_id: (n_lines, n_removed, text)}."""
    lines = []
    for d, t in docs.items():
        for k, x in enumerate(t.split("\n") if t is not None else []):
            w = [y.decode() for y in WORD.findall(x.encode())]
            if w:
                m = ["<*>" if re.search("[0-9]", y) else y for y in w]
                lines.append((d, t, k, (len(w), *m[:depth]), m))
    count = lambda pairs: {k: len({t for a, t in pairs if a == k}) for k in {a for a, _ in pairs}}
    leaves = count([(x[3], x[1]) for x in lines])
    lines = [x for x in lines if leaves[x[3]] >= least]
    tokens = count([((x[3], i, y), x[1]) for x in lines for i, y in enumerate(x[4]) if y != "<*>"])
    shaped = []
    for d, t, k, leaf, m in lines:
        fixed = tuple((i, y) for i, y in enumerate(m) if tokens.get((leaf, i, y), 0) >= least)
        if fixed and len(fixed) >= constant * len(m):
            shaped.append((d, t, k, (leaf, fixed)))
    templates = count([(x[3], x[1]) for x in shaped])
    gone = defaultdict(set)
    for d, _, k, key in shaped:
        if templates[key] >= least:
            gone[d].add(k)
    out = {}
    for d, t in docs.items():
        parts = t.split("\n") if t is not None else []
        n = sum(bool(WORD.search(x.encode())) for x in parts)
        g = gone[d] if len(gone[d]) <= most_share * n else set()
        out[d] = (n, len(g), "\n".join(x for i, x in enumerate(parts) if i not in g) if g else t)
    return out
