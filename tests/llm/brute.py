"""Plain versions of the operators, over lists."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs}
    holders, parent = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def covered(w, n):
    at = {}
    for i in range(len(w) - n + 1):
        at.setdefault(tuple(w[i : i + n]), []).append(i)
    inside = set()
    for places in at.values():
        if len(places) > 1:
            inside.update(i + k for i in places for k in range(n))
    return inside


def quality(text, rules):
    w = words(text)
    chars = max(1, sum(map(len, w)))
    seen, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, words(line)))
            seen.add(line)
    repeat, symbols = len(covered(w, rules.window)), len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < rules.min_words or 100 * repeat > rules.max_repeat_pct * len(w)
    fine = dup_chars / chars <= rules.max_line_coverage and symbols <= rules.max_symbol_ratio * len(w)
    fine = fine and all(sum(len(w[i]) for i in covered(w, k)) / chars <= most for k, most in rules.max_coverage)
    return [len(w), sum(map(len, w)), symbols, dup, repeat, failed, not failed and fine]


def line_dedup(docs, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    keys = {d: [lower(x).strip(strip) for x in (t or "").split("\n")] for d, t in docs}
    holders = {}
    for d, ks in keys.items():
        for k in ks:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(d)
    gone = lambda d, k: len(holders.get(k, ())) >= min_docs and max(holders[k]) != d
    return {d: "\n".join(x for x, k in zip((t or "").split("\n"), keys[d]) if not gone(d, k)) for d, t in docs}


def contained(docs, items, size=5, percent=80):
    out = {}
    for i, t in items:
        w = words(lower(t))
        k = min(size, len(w))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, text in docs:
            v = words(lower(text))
            n = len(want & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) if want else 0
            if want and 100 * n >= percent * len(want):
                out[d, i] = (len(want), n)
    return out


def bpe(docs):
    t = Tokenizer.from_file(VOCABULARY)
    out = {}
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    return out
