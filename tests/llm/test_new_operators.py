"""Operators 11 to 13 against plain versions on awkward rows, and their own rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.llm import chat_trees, divergence, target_resampling
from gaitspark.llm.target_resampling import Towards


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        v = len(kept)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, c in counts.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            tops = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", tops, top)):
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)}
    return out


@pytest.fixture(scope="module")
def mixed():
    """Texts of four sources and two languages with nulls, blanks, other scripts, repeated rows and a long one."""
    rng = random.Random(5)
    vocabulary = ["The", "a", "über", "Straße", "слово", "x9y", "same", "é", "it's", "語彙", *[f"w{chr(97 + i)}" for i in range(20)]]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(3, len(vocabulary))]) + rng.choice(["", ".", "\n", "\x00", "1"]) for _ in range(n))
    rows = [(rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "Z"]), say(rng.randrange(40))) for _ in range(150)]
    return rows + [rows[0]] * 40 + [(None, "a", "x"), ("en", None, say(9)), ("en", "", None), ("en", "only", "7 !"), ("fr", "a", "un"), ("fr", "b", "deux"), (None, None, None), ("de", "b", say(20_000))]


def test_divergence(spark, mixed):
    docs = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(mixed)], "doc_id long, lang string, source string, text string, TEXT string").repartition(5)
    for least, top in ((3, 10), (10, 2), (10_000, 10)):
        got = [tuple(r) for r in divergence.audit(docs, least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_audit(mixed, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_joint_histograms_hold_zero_cells(spark):
    cells = spark.createDataFrame([("en", "a", "t", 2), ("en", "a", "u", 2), ("en", "b", "u", 5), ("en", "b", "v", 1)], "lang string, source string, term string, n long")
    pairs = spark.createDataFrame([("en", "a", "b", 7)], "lang string, a string, b string, kept long")
    got = {tuple(r)[3:] for r in divergence.joint_histograms(cells, pairs).collect()}
    assert got == {(2, 5, 1), (2, 0, 1), (0, 1, 1), (0, 0, 4)}


def test_shares_of_huge_counts(spark):
    got = spark.range(1).select(divergence.share(F.lit(10**17), F.lit(3 * 10**17), F.lit(5))).first()[0]
    assert got == 1 + 10**9 * (10**17 + 2) // (3 * 10**17 + 10)


def plain_resampling(docs, target, how):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % how.buckets for n in range(1, how.longest + 1) for i in range(len(w) - n + 1)]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + how.buckets) / ((s[b] + 1) * (t.total() + how.buckets))))
    rows = []
    for d, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= how.min_words))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: how.percent * len(drawn) // 100]
    rank = {id(r): k for k, r in enumerate(drawn, 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("how", [Towards(), Towards(buckets=50, longest=3, percent=60, min_words=2), Towards(buckets=300, longest=5, percent=100), Towards(longest=1, percent=0)])
def test_resampling(spark, mixed, how):
    rows = [(i if i % 17 else None, r[2]) for i, r in enumerate(mixed)]
    target = [mixed[1][2], "The same same über", None, ""]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, Text string").repartition(4)
    got = target_resampling.resample_towards(docs, spark.createDataFrame([(t,) for t in target], "text string"), how)
    want = plain_resampling(rows, target, how)
    have = sorted(map(tuple, got.collect()), key=repr)
    if how.percent < 100:  # equal rows of null ids may change places
        assert [r[:4] for r in have] == [r[:4] for r in want] and sorted(r[4] or 0 for r in have) == sorted(r[4] or 0 for r in want)
    assert {r for r in have if r[0] is not None} == {r for r in want if r[0] is not None}
    assert target_resampling.resample_towards(docs.limit(0), spark.createDataFrame([], "text string"), how).count() == 0


def test_repeated_rows_compete_each(spark):
    docs = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one two three " * 10).alias("text"))
    ranks = [r["rank"] for r in target_resampling.resample_towards(docs, docs.select("text").limit(1)).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 101)) and ranks.count(None) == 300


def test_suffix_array():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)).encode() for n in (0, 1, 7, 40, 2)] + [None]
    for depth in (1, 2, 3, 5, 8):
        w = target_resampling.numbered_words(texts)
        order, lcp = target_resampling.suffix_array(w, depth)
        own = [tuple(w.ids[i : i + min(depth, w.left[i])]) for i in range(len(w.ids))]
        found = [own[i] for i in order]
        assert found == sorted(own)
        share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert list(lcp) == [0, *[share(a, b) for a, b in zip(found, found[1:])]][: len(lcp)]
        for n, (_, places, lengths, hashed) in enumerate(target_resampling.bucket_runs(texts, Towards(longest=depth)), 1):
            grams = Counter(" ".join(t.decode().split()[i : i + n]) for t in texts if t for i in range(len(t.split()) - n + 1))
            assert len(places) == lengths.sum() == grams.total() and len(hashed) == len(grams) and sorted(lengths) == sorted(grams.values())


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


TRICKY = ["<|im_end|>", "<\\|im_start|>x", "<<||>>\\<\\\\|", "", None, "line\nline\r\n ", "ü語\x00", "<|im_end|><|im_start|>assistant ok", "%0A%25", "a" * 100_000]


def test_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "%0A", "<|r|>"]), rng.choice(TRICKY)) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 9))]
    rows += [(4, t % 3, "assistant", f"<|{t}") for t in range(7)] + [(5, 0, "user", "same")] * 3 + [(6, t, "assistant" if t % 2 else "user", str(t)) for t in range(70)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ROLE long")
    made = chat_trees.format_trees(chat_trees.conversation_trees(df), branches=1)
    got = made.select("tree_id", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"), chat_trees.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["turns"]] == want[r["tree_id"]]
        assert r["learned"] == "".join(t for role, t in want[r["tree_id"]] if role == "assistant")
        assert r["formatted"].count(chat_trees.START) == r["formatted"].count(chat_trees.END) == len(want[r["tree_id"]])
    assert chat_trees.format_trees(chat_trees.conversation_trees(df.limit(0))).count() == 0


def test_reply_trees(spark):
    """Branches by score, orphans, repeated rows, null ids, other trees' ids."""
    m = [
        ("t", "r", None, "user", "root", 1.0), ("t", "a", "r", "assistant", "A", 2.0), ("t", "b", "r", "assistant", "B", 3.0), ("t", "c", "a", "user", "C", 5.0), ("t", "d", "a", "user", "D", None),
        ("t", "d", "a", "user", "D", None), ("t", "o", "lost", "assistant", "O", 0.5), ("u", "r", None, "user", "other", 1.0), (None, "r", None, "user", "none", 1.0), (None, "x", "r", "assistant", "X", 1.0), ("t", None, "b", "assistant", "N", 0.0),
    ]
    df = spark.createDataFrame(m, "tree_id string, node_id string, parent_id string, role string, text string, score double")
    paths = lambda found: sorted(((r["tree_id"], r["path_rank"], r["score"], "-".join(t["text"] for t in r["turns"])) for r in found.select("*", chat_trees.read_turns(F.col("formatted")).alias("turns")).collect()), key=repr)
    got = paths(chat_trees.format_trees(df, score_col="score"))
    assert got == sorted([("t", 1, 8.0, "root-A-C"), ("t", 2, 4.0, "root-B-N"), ("t", 3, 3.0, "root-A-D"), ("t", 4, 0.5, "O"), ("u", 1, 1.0, "other"), (None, 1, 2.0, "none-X")], key=repr)
    assert paths(chat_trees.format_trees(df, branches=2, score_col="score")) == [r for r in got if r[1] <= 2]
    spans = {r["leaf"]: [r["formatted"].encode()[s["start"] : s["start"] + s["size"]] for s in r["loss"]] for r in chat_trees.format_trees(df).collect()}
    assert spans["c"] == [b"A"] and spans["x"] == [b"X"] and spans["o"] == [b"O"]
    with pytest.raises(ValueError, match="circle"):
        chat_trees.format_trees(spark.createDataFrame([("t", "a", "b", "", "", 1.0), ("t", "b", "a", "", "", 1.0), ("t", "c", "a", "", "", 1.0)], df.schema)).collect()


def test_gains_are_exact():
    raw, target = np.array([0, 5, 10**9]), np.array([0, 0, 7])
    assert list(target_resampling.bucket_gains(raw, target)) == [math.floor(1000 * math.log((t + 1) * (10**9 + 8) / ((s + 1) * 10))) for s, t in ((0, 0), (5, 0), (10**9, 7))]


def test_terms_are_summed_in_tasks(spark):
    """A task hands on a term of a group once where they are few, and no partial sums are made again before they are dealt."""
    docs = spark.createDataFrame([("en", "a", f"one two two w{chr(97 + i // 26)}{chr(97 + i % 26)} é") for i in range(300)] + [("en", "b", "")], "lang string, source string, text string").coalesce(1)
    rows = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(docs).collect()}
    assert rows[("en", "a", "two")] == (600, 300) and rows[("en", "a", "é")] == (300, 300) and rows[("en", "b", "")] == (0, 0) == rows[("en", "a", "")]
    assert len(rows) == 305 == divergence.term_counts(docs).count()
    plan = divergence.whole_counts(divergence.term_counts(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.rindex("HashAggregate")
