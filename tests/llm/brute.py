"""Plain single-process versions of the operators, from their contracts, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lm(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score, score)} for [(doc_id, text)]."""
    toks = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, [*WORD.findall(low(t)), "<end>"]) for d, t in docs]
    c = Counter()  # of n-grams as tuples
    for _, held, ts in toks:
        if not held:
            for i, w in enumerate(ts):
                c[w,] += 1
                c["<start>",] += i == 0
                whole = ["<start>", *ts[: i + 1]]
                c.update([tuple(whole[-2:])] + ([tuple(whole[-3:])] if len(whole) > 2 else []))
    n, v = sum(k for g, k in c.items() if len(g) == 1 and g != ("<start>",)), sum(len(g) == 1 and g != ("<start>",) and k > 0 for g, k in c.items())
    p1 = lambda w: (c[w,] + 0.1) / (n + 0.1 * (v + 1))

    def p(h, w):
        """Probability of w after the tuple h of words."""
        if not h:
            return p1(w)
        if not c[h]:
            return p(h[1:], w)
        back = c[h] ** 0.75
        return (c[*h, w] + back * p(h[1:], w)) / (c[h] + back)

    out = []
    for d, held, ts in toks:
        whole = ["<start>", *ts]
        score = sum(math.log10(p(tuple(whole[max(0, i - 2) : i]), whole[i])) for i in range(1, len(whole)))
        out.append((d, held, len(ts), sum(c[w,] > 0 for w in ts), n, sum(math.log10(p1(w)) for w in ts), score))
    return out


def decontaminate(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        ws = PLAIN.findall(low(t))
        size = min(10, len(ws))
        for a in range(len(ws) - size + 1) if ws else ():
            wins[tuple(ws[a : a + size])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        ws = PLAIN.findall(low(t))
        hit, ids = set(), set()
        for size in sizes:
            for a in range(len(ws) - size + 1):
                if found := wins.get(tuple(ws[a : a + size])):
                    hit.update(range(a, a + size))
                    ids |= found
        names = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(ws), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def near(docs, k, percent):
    """[(doc_id, n_shingles, component_id)]"""
    sets = []
    for _, t in docs:
        ws = WORD.findall(low(t))
        sets.append({tuple(ws[a : a + k]) for a in range(max(1, len(ws) - k + 1))} if ws else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for a, i in enumerate(group):
            for j in group[a + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[find(i)] = find(j)
    key = lambda d: (d is None, d or 0)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=key)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def token_ids(docs, tokenizer, end_id=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    out, start = [], 0
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def repeats(docs, k=100):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]: docs in order."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - k + 1):
            g = raw[a : a + k]
            if g in seen:
                gone[a : a + k] = b"\x01" * k
            else:
                seen.add(g)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, sha(bytes(x for x, g in zip(raw, gone, strict=True) if not g))))
    return out


def quality(docs):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]"""
    out = []
    for d, t in docs:
        t = t or ""
        ws = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        wins = defaultdict(list)
        for a in range(len(ws) - 7):
            wins[tuple(ws[a : a + 8])].append(a)
        again = {p for at in wins.values() if len(at) > 1 for a in at for p in range(a, a + 8)}
        out.append((d, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(ws) < 20 or 100 * len(again) > 30 * len(ws)))
    return out


def line_dedup(docs, align):
    """[(doc_id, n_lines, n_deleted, text)]: distinct rows in order, each aligned with all before it."""
    out, before = [], []
    for d, t in docs:
        ls = t.split("\n") if t else []
        gone = {j for e in before for _, j in align(e, ls)}
        before.append(ls)
        out.append((d, len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone)))
    return out
