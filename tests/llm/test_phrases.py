"""Phrase mining: brute force, automata, images and defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from skewlens.llm import phrases
from skewlens.llm.phrases import Automaton

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("lang", "text", "phrase", "a", "range")])


def brute(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            longer = [x for x in f if x[0] == lang and len(x) == len(w) + 2 and f[x] >= least and (list(x[1:-1]) == w or list(x[2:]) == w)]
            if any(100 * f[x] >= 50 * a for x in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), set()
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.add((lang, rank[lang], *rest))
    return ranked


def found(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(lang, text, "x", "x", "x") for lang, text in rows], SCHEMA).repartition(3)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "Of", "é", "a" * 9, "b" * 17, "ZÉ", "new", "york", "city", "\xa0", "x"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(30)):
            parts.append(r.choice([r.choice(words), "new york", "New York City", "the of", "".join(r.choice("ab") for _ in range(3))]))
            parts.append(r.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", "; "]))
        out.append((r.choice(["en", "en", "de", None, "und", ""]), "".join(parts)))
    return out


@pytest.mark.parametrize("held, cells", [(1 << 21, 1 << 28), (50, 1 << 16)])
def test_equals_brute_force(spark, monkeypatch, held, cells):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "MAX_CELLS", cells)
    monkeypatch.setattr(phrases, "CHUNK", held)
    monkeypatch.setattr(phrases, "PER_RANGE", 1000)
    rows = texts(5, 250) + [("en", None), ("en", ""), ("xx", " ,. ")]
    want = brute(rows)
    assert found(phrases.mine_phrases(table(spark, rows))) == want
    assert len(want) > 40 and found(phrases.mine_phrases(table(spark, rows), top=3)) == brute(rows, top=3)


def test_real_texts(spark, small):
    rows = [(r.lang, r.text) for r in small.limit(60).collect()]
    assert found(phrases.mine_phrases(table(spark, rows))) == brute(rows)


def test_very_long_text_and_empty_table(spark):
    rows = [("en", "one two three " * 40_000), ("en", "w" * 100_000)]
    assert found(phrases.mine_phrases(table(spark, rows))) == brute(rows)
    assert phrases.mine_phrases(table(spark, rows).limit(0)).collect() == []


def test_automaton_is_minimal_and_keeps_weights():
    r = random.Random(2)
    items = Counter()
    for _ in range(500):
        items[tuple(r.choice("abcd") for _ in range(r.randrange(5)))] += r.choice([1, 1, 7])
    built = Automaton.build(sorted(items.items()))
    assert dict(built.paths()) == items and len(set(built.states)) == len(built.states)
    again = Automaton.from_bytes(built.to_bytes())
    assert again.states == built.states
    parts = [Counter(), Counter(), Counter()]
    for path, n in items.items():
        for _ in range(n):
            r.choice(parts)[path] += 1
    joined = Automaton.union([Automaton.build(sorted(p.items())) for p in parts])
    assert joined.states == built.states
    wanted = sorted({tuple(r.choice("abcde") for _ in range(r.randrange(5))) for _ in range(200)})
    assert dict(built.compose(Automaton.build((w, 1) for w in wanted))) == {w: items[w] for w in wanted if w in items}


def test_suffixes_are_shared():
    items = sorted(((a, b), 1) for a in "abcdefgh" for b in "xyz")
    assert len(Automaton.build(items).states) == 3  # the end, the state before it, the root


def test_images_depend_on_the_whole_word():
    words = ["", "a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 16 + "b", "b" * 17, "é" * 20]
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw])
    for body in (b"".join(raw) + b"\n" * 8, b"".join(raw) + b"zzzzzzzz"):
        got = phrases.word_images(body, np.cumsum(lengths) - lengths, lengths, np.full(len(raw), 5, np.uint64))
        assert len(set(got.tolist())) == len(words)
    assert got[1] == phrases.word_images(b"xxa" + b"q" * 8, np.array([2]), np.array([1]), np.array([5], np.uint64))[0]
