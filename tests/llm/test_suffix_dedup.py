"""Repeated byte strings: brute force, all covers, hot and defined cases."""

import random

import numpy as np
import pytest

from skewlens.llm import suffix_dedup


def brute(rows, length):
    """{row number: (bytes, removed, spans, kept)} by comparing all strings."""
    rows = [(suffix_dedup.LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            least[t[p:p + length]] = min(i, least.get(t[p:p + length], i))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        spans, p = [], 0
        while p < len(t):
            if gone[p]:
                q = p
                while q < len(t) and gone[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append((None if i == suffix_dedup.LAST else i, len(t), sum(b - a for a, b in spans), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def texts(seed, n, alphabet="ab é", passages=6, length=70):
    """Texts that share passages and parts of passages, at any offset."""
    r = random.Random(seed)
    shared = ["".join(r.choice(alphabet + "cdefgh") for _ in range(r.randrange(20, length))) for _ in range(passages)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            parts.append(r.choice([p, p[a:], p[:a], "".join(r.choice("ijklmnop") for _ in range(r.randrange(40)))]))
        out.append((i, "".join(parts)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("length", [10, 20, 50, 80])
def test_equals_brute_force_with_any_cover(spark, make_docs, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PER_BUCKET", 300)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 400)
    rows = texts(length, 60, length=140)
    got = found(suffix_dedup.remove_repeats(make_docs(rows), min_length=length))
    assert got == brute(rows, length)
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_covers_hold_every_difference():
    for v, residues in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))
    with pytest.raises(ValueError):
        suffix_dedup.cover(9)


def test_defined_cases(spark, make_docs):
    long = "a very long text " * 20_000
    rows = [
        (3, "x" * 49), (1, "x" * 49), (2, "y" * 50), (5, "y" * 50), (4, None), (6, ""), (7, "y" * 51), (7, "y" * 51 + "tail"),
        (None, "z" * 60), (None, "z" * 60), (8, "z" * 60), (9, "é" * 25), (10, "pre" + "é" * 25), (11, long), (12, long[1:]),
    ]
    got = {}
    for r in suffix_dedup.remove_repeats(make_docs(rows, extra=("id", "kept", "block"))).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, len(r.spans), len(r.kept)))
    assert got[1] == got[3] == [(49, 0, 0, 49)]
    assert got[2] == [(50, 0, 0, 50)] and got[5] == [(50, 50, 1, 0)]
    assert got[4] == got[6] == [(0, 0, 0, 0)]
    assert sorted(got[7]) == [(51, 51, 1, 0), (55, 51, 1, 4)]
    assert got[8] == [(60, 0, 0, 60)] and got[None] == [(60, 60, 1, 0)] * 2
    assert got[9] == [(50, 0, 0, 50)] and got[10] == [(53, 50, 1, 3)]
    assert got[11] == [(len(long), 0, 0, len(long))] and got[12] == [(len(long) - 1, len(long) - 1, 1, 0)]


def test_empty_table(spark, make_docs):
    assert suffix_dedup.remove_repeats(make_docs([(1, "a")]).limit(0)).collect() == []


def test_hot_passage_is_sent_once_a_block(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    passage = "".join(random.Random(1).choice("abcdefgh ") for _ in range(200))
    rows = [(i, f"{i:06d}" + passage) for i in range(1500)]
    got = suffix_dedup.remove_repeats(make_docs(rows)).filter("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_numbers_travel_whole():
    for top in (1, 200, 1 << 20, (1 << 64) - 1):
        numbers = np.array([0, top, top // 2], np.uint64)
        raw, width = suffix_dedup.packed(numbers)
        assert (suffix_dedup.unpacked(raw, width) == numbers).all() and len(raw) == 3 * width
