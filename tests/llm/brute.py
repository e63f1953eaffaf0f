"""Plain versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def near_duplicates(docs, percent):
    """{doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d, s in sets.items():
        for o, k in Counter(o for g in s for o in holders[g] if o > d).items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def suffix_dedup(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept sha)}"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def substring_dedup(docs, window=13):
    """{doc_id: (n_words, n_removed, kept sha)}"""
    first, words, out = {}, {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        words[d] = (t or "").encode().split()
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def line_dedup(docs, max_ratio=0.1, min_pages=5):
    """docs: (doc_id, host, text) -> {doc_id: text}"""
    pages, holders = Counter(h for _, h, _ in docs), defaultdict(set)
    spaces = " \t\r\x0b\x0c"
    for i, (_, h, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            holders[h, line.strip(spaces)].add(i)
    boiler = {
        k for k, v in holders.items() if k[1] and len(v) >= min_pages and len(v) > max_ratio * pages[k[0]]
    }
    return {
        d: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(spaces)) not in boiler)
        for d, h, t in docs
    }


def runs(words):
    """Every (start, length, smallest period) of a stretch of max(12, 2 * period) words that no neighbour extends."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)  # a multiple of the period makes the same stretch
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic(doc_id, text, plant):
    """(n_runs, start, length, period, exponent_milli, runs sha, collapsed sha)"""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and w and h % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return len(found), *longest, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(kept)


def divergence(rows, min_docs, top):
    """rows: (lang, source, text) -> {(lang, source, part, item, value, rank)}"""
    pages, counts, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        fold = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold)
        pages.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
        whole[lang].update(found)
    kept = defaultdict(list)
    for (lang, t), n in pages.items():
        if n >= min_docs:
            kept[lang].append(t)
    shares = {}
    for name, c in [*counts.items(), *whole.items()]:
        v = kept[name[0] if isinstance(name, tuple) else name]
        n = sum(c[t] for t in v)
        shares[name] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(v)) for t in v}
    out = set()
    for lang, source in counts:
        p = shares[lang, source]
        pairs = [(o, sum(abs(p[t] - shares[x, o][t]) for t in p)) for x, o in counts if x == lang and o != source]
        some = [(t, p[t] - shares[lang][t]) for t in p if counts[lang, source][t] and p[t] > shares[lang][t]]
        for part, items, limit in (("pair", pairs, len(pairs)), ("term", some, top)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out |= {(lang, source, part, item, f, k + 1) for k, (item, f) in enumerate(order)}
    return out


def ngrams(text, orders, bits):
    """Buckets of the n-grams of letters and gaps, one by one."""
    full = 2**64 - 1
    letters = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    for order in orders:
        for i in range(len(letters) - order + 1):
            part = letters[i : i + order]
            if set(part) == {32}:
                continue
            acc = order
            for c in part:
                acc = (acc ^ c) * 0x9E3779B97F4A7C15 & full
                acc ^= acc >> 29
            yield (acc * 0xBF58476D1CE4E5B9 & full) >> (64 - bits)


def languages(rows, orders=(1, 2, 3), bits=16, alpha=0.5):
    """rows: (doc_id, text, lang) -> {doc_id: (held_out, language, posterior)} of naive Bayes over all rows not held out."""
    out_of = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows}
    counts, pages = defaultdict(Counter), Counter()
    for d, text, lang in rows:
        if not out_of[d] and text is not None and lang is not None:
            counts[lang].update(ngrams(text, orders, bits))
            pages[lang] += 1
    names = sorted(pages)
    total = {x: sum(counts[x].values()) + alpha * 2**bits for x in names}
    out = {}
    for d, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[d] = (out_of[d], "und", 0.0)
            continue
        own = Counter(ngrams(text, orders, bits))
        logs = [
            math.log((pages[x] + 1) / (sum(pages.values()) + len(names)))
            + sum(n * math.log((counts[x][b] + alpha) / total[x]) for b, n in own.items())
            for x in names
        ]
        best = max(range(len(names)), key=lambda i: logs[i])
        out[d] = (out_of[d], names[best], 1 / sum(math.exp(v - logs[best]) for v in logs))
    return out
