"""Spelling variants: brute force over all pairs, tiles, damage, chains and defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.llm import spelling


def counted(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n, out, form = counted(rows), {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(x, w)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(seed, n):
    """Words of few letters with their variants, from very rare to very common."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(7, 11))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * r.choice([2, 3, 30, 400])
        for _ in range(3):
            i = r.randrange(len(w))
            out += [r.choice([w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "É" + w[i + 1:], w.upper()])] * r.choice([1, 2, 25])
    r.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [4096, 20])
def test_equals_brute_force(spark, make_docs, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling.near_counts, "__defaults__", (spelling.MIN_LENGTH, tile))
    words = vocabulary(3, 40)
    rows = [(i, " ".join(words[i::50])) for i in range(50)] + [(None, words[0] + "," + words[1]), (1, words[0]), (99, None), (98, "")]
    want = brute(rows)
    assert found(spelling.spelling_variants(make_docs(rows, extra=("word", "n", "run")))) == want
    assert sum(1 for r in want if r[1]) > 5 and any(r[1] != r[2] and r[1] for r in want)


def test_real_words(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert found(spelling.spelling_variants(small)) == brute(rows)


def test_pairs_of_a_block_by_products():
    r = random.Random(1)
    block = sorted({"".join(r.choice("abÿ") for _ in range(r.choice([7, 8]))).encode("latin-1") for _ in range(700)})
    for side in (None, np.array([r.randrange(2) for _ in block])):
        got = set()
        for half in (spelling.FIRST_HALF, spelling.SECOND_HALF):
            i, j = spelling.near_words(block, side, 7, half)
            pairs = list(zip(i.tolist(), j.tolist()))
            assert len(pairs) == len(set(pairs)) and not got & set(pairs)
            got |= set(pairs)
        want = {
            (i, j) for i, a in enumerate(block) for j, b in enumerate(block)
            if min(len(a), len(b)) == 7 and near(a, b) and (side is None or side[i] != side[j])
        }
        assert got == want and want


def test_chain_of_forms(spark, make_docs):
    texts = ["abcdefgh "] * 2 + ["abcdefghi "] * 30 + ["abcdefghij "] * 400 + ["abcdefghijk "] * 5000
    rows = [(0, "".join(texts))]
    got = {r[0]: r for r in found(spelling.spelling_variants(make_docs(rows)))}
    if all(zlib.crc32(f"0:{w.strip()}".encode()) % 31 for w in set(texts)):
        assert got["abcdefgh"] == ("abcdefgh", "abcdefghi", "abcdefghijk", 2, 1, 30)
    assert got == {r[0]: r for r in brute(rows)}


def test_very_long_word_and_empty_table(spark, make_docs):
    rows = [(1, "a" * 30_000 + " " + "a" * 30_000), (2, "a" * 29_999 + "b " + "a" * 29_999 + "b")]
    assert found(spelling.spelling_variants(make_docs(rows))) == brute(rows)
    assert spelling.spelling_variants(make_docs(rows).limit(0)).filter(F.lit(True)).collect() == []
