"""Brute-force versions of the operators, from their definitions alone."""

import hashlib
import re

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fingerprint(text):
    words = WS.findall(lower_az(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(fps, bits):
    """Component number (least index) by index."""
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def base_counts(text):
    text = text or ""
    words = WS.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WS.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def without_repeats(docs, length=100):
    """docs: (id, bytes), ids unique. {id: (n_bytes, n_removed, n_spans, sha256 of the rest)}"""
    first = {}
    for d, t in sorted(docs):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i:i + length], (d, i))
    out = {}
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] != (d, i):
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    """items: (id, text). (n_words, n_hit, sorted item ids)"""
    words = BENCH.findall(lower_az(text or ""))
    hit, found = set(), set()
    for i, t in items:
        ws = BENCH.findall(lower_az(t or ""))
        m = min(10, len(ws))
        for s in range(len(ws) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p:p + m] == ws[s:s + m]:
                    hit |= set(range(p, p + m))
                    found.add(i)
    return len(words), len(hit), sorted(found)


def integer_vector(vector):
    """floor(256 * x) of each component, or None if the vector takes no part."""
    import math
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(256 * x) for x in vector)


def id_order(i):
    return (i is None, i)


def best_rows(rows, query, asked, k):
    """rows: distinct (id, vector). The k best of another id, as (id, score)."""
    found = [(-sum(a * b for a, b in zip(v, query)), id_order(i)) for i, v in rows if i != asked and len(v) == len(query)]
    return [(i[1], -s) for s, i in sorted(found)[:k]]


def negatives(rows, is_anchor, n_positives, n_negatives):
    """rows: (id, vector, label). Rows (anchor, positive, rank, negative, positive score, negative score)."""
    rows = {(i, lab, integer_vector(v)) for i, v, lab in rows if lab is not None and integer_vector(v) is not None}
    out = []
    for a, lab, q in rows:
        if a is None or not is_anchor(a):
            continue
        same = [(i, v) for i, x, v in rows if x == lab]
        others = [(i, v) for i, x, v in rows if x != lab]
        scored = best_rows(others, q, object(), len(others))
        for p, ps in best_rows(same, q, a, n_positives):
            window = [(i, s) for i, s in scored if 30 * ps <= 100 * s <= 90 * ps][:n_negatives]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(window, 1)]
    return out


def spelling_words(docs, least=6, count=5, one_in=199):
    """docs: (id, text). {word: n}"""
    import collections
    import zlib
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_az(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_variants(words, ratio=5):
    """{word: (form, root, n, number of near words, count of the form)}"""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out
