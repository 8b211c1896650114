"""Phrase collocations: summaries, filters and cutting against plain versions, the operator against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from barloom.llm import phrases
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aAéÉ门 \t.,;:!?\n\x0b\x0c\r\0\x85 '"), max_size=25), max_size=6))
def test_words_and_grams(texts):
    text = phrases.Text(pa.array(texts, pa.string()), pa.array([None] * len(texts), pa.string()))
    want = [(i, j > 0, w) for i, t in enumerate(texts) for p in pieces(t) for j, w in enumerate(p)]
    words = text.words.to_pylist()
    assert [(d, f, words[c]) for d, f, c in zip(text.doc.tolist(), text.follows.tolist(), text.code.tolist(), strict=True)] == want
    for n in (1, 2, 3, 4):
        key, there = text.grams(n)
        grams = Counter(" ".join(p[i : i + n]) for t in texts for p in pieces(t) for i in range(len(p) - n + 1))
        at = np.flatnonzero(there)
        assert dict(zip(*text.count(at, key[at], n).drop(["lang"]).to_pydict().values(), strict=True)) == grams
        assert dict(zip(*text.count(at, key[at] & np.uint64(1), n).drop(["lang"]).to_pydict().values(), strict=True)) == grams  # hashes that collide
        some = list(grams)
        again = phrases.phrase_keys(pa.array(["und"] * len(some), pa.string()), pa.array(some, pa.string()))
        assert {*again.tolist()} == {*key[at].tolist()}


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(4)
    for least in (3, 10, 30):
        true, parts = Counter(), []
        for _ in range(12):
            x = np.minimum(rng.zipf(1.3, 800), 10**6).astype(np.uint64)
            keys, counts = np.unique(x, return_counts=True)
            true.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            parts.append((keys, counts.astype(np.int64)))
        summary = phrases.Summary(sum(true.values()) // least + 1)
        for half in (parts[:5], parts[5:]):  # summaries merge as counts do
            one = phrases.Summary(summary.capacity)
            for p in half:
                one.merge(*p)
            summary.merge(one.keys, one.counts, one.lowered)
        assert len(summary.keys) <= summary.capacity and summary.lowered < least
        assert all(c <= true[k] <= c + summary.lowered for k, c in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
        assert {k for k, c in true.items() if c >= least} <= {*summary.may_reach(least).tolist()}
    tight = phrases.Summary(3)
    tight.merge(np.arange(10, dtype=np.uint64), np.array([5, 1, 1, 1, 4, 1, 1, 1, 3, 1]))
    assert tight.keys.tolist() == [0, 4, 8] and tight.counts.tolist() == [4, 3, 2] and tight.lowered == 1


def test_filter_never_denies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, 100_000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for most in (1024, 2):  # the second: many more keys than the bound is made for
        monkeypatch.setattr(phrases, "SEGMENTS", most)
        known = phrases.Filter(phrases.make_filter(df))
        assert len(known.bits) == min(most, 4) and known.has(keys.view(np.uint64)).all()
        passed = known.has(rng.integers(0, 2**63, 100_000).astype(np.uint64)).mean()
        assert passed < (0.02 if most > 2 else 0.2)
    assert not phrases.Filter(phrases.make_filter(df.where("false"))).has(keys.view(np.uint64)).any()


def plain(rows, longest=4, least=30, inside=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        covered = Counter()
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    covered[g[i : i + m]] = max(covered[g[i : i + m]], a)
        best = []
        for g, a in cand.items():
            if 100 * covered[g] >= inside * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def corpus():
    random.seed(6)
    words = [f"w{i}" for i in range(12)] + ["Über", "ǅ", "É", "a\x85b"]
    rows = []
    for i in range(240):
        text = "".join(random.choice(words) + random.choices([" ", " \t", ", ", ".", "\n"], [20, 2, 3, 2, 1])[0] for _ in range(random.randrange(60)))
        rows.append((random.choice(["en", "de", "und", None]), text + " Twin towers stand Here" * (i % 3)))
    return rows + [("en", "so so so so so"), ("en", None), ("de", ""), ("de", " . "), (None, "lone")] + [("en", "a copied line of many words, again")] * 40


@pytest.mark.parametrize("sizes", [{}, {"least": 5, "top": 40}, {"longest": 2, "least": 12, "inside": 50}, {"longest": 3, "least": 1}])
def test_against_plain(spark, sizes, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("phrase", "n", "f", "k", "w", "size", "score", "rank", "a", "l", "r")})
    got = phrases.collocations(df, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in got.dtypes} == {"string", "bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows, **sizes) != []


def test_many_partitions_and_small_gatherers(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 50)
    rows = corpus()
    found, sizes = phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=8, mass=900)
    counts = defaultdict(Counter)
    for lang, text in rows:
        for p in pieces(text):
            for k in range(1, 5):
                counts[lang or "und"].update(" ".join(p[i : i + k]) for i in range(len(p) - k + 1))
    assert {(r["lang"], r["phrase"]): r["f"] for r in found.collect()} == {(lang, p): f for lang, c in counts.items() for p, f in c.items() if f >= 8}
    assert {r["lang"]: r["n"] for r in sizes.collect()} == {lang: sum(f for p, f in c.items() if " " not in p) for lang, c in counts.items()}


def test_odd_rows_and_empty_tables(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()] * 20
    df = odd
    for _ in range(19):
        df = df.unionByName(odd)
    assert sorted(map(tuple, phrases.collocations(df, least=30).collect())) == plain(rows)
    assert phrases.collocations(odd.where("false")).count() == 0
