import itertools
import random

import numpy as np
import pytest

from skewlens.llm import mixing as m


def brute_targets(sizes):
    """The rounds of sharing as they are described: excess of full sources goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, target = set(names), {}
    left = 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def docs_of(seed, n, sources):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * (rnd.randrange(1, 12) if i % 9 else rnd.randrange(300))), rnd.choices(sources, weights=range(1, len(sources) + 1))[0]) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["Z", "é", "z", "a", "~", "b", "c"], [None], ["only"]])
def test_targets_and_words(make_docs, sources):
    rows = docs_of(5, 400, sources)
    got = m.mix(make_docs(rows, extra=("size", "h", "idx", "copies"))).collect()
    sizes, taken = {}, {}
    for (_, t, s) in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])  # short documents fill any gap


def test_reruns_agree_and_seeds_differ(make_docs):
    docs = make_docs(docs_of(1, 300, ["a", "b", "c"]))
    runs = [{(r.doc_id, r.copies) for r in m.mix(docs.repartition(n), seed=s).collect()} for n, s in ((2, 17), (5, 17), (2, 18))]
    assert runs[0] == runs[1] != runs[2]


def test_many_documents_of_one_length(make_docs):
    """Several hash buckets of one length: exactly the wanted number is taken."""
    rows = [(i, "one two three", "a") for i in range(5000)] + [(10_000 + i, "one two", s) for i, s in enumerate("bcdefg")]
    got = [r for r in m.mix(make_docs(rows)).collect() if r.source == "a"]
    assert sum(r.copies * r.size for r in got) == pytest.approx(got[0].target, abs=3)
    assert {r.copies for r in got} <= {0, 1, 2}


def best_sum(sizes, counts, budget):
    return max(t for t in (sum(a * b for a, b in zip(sizes, take)) for take in itertools.product(*(range(c + 1) for c in counts))) if t <= budget)


def test_knapsack_is_exact():
    rnd = random.Random(2)
    for _ in range(200):
        sizes = np.array(sorted(rnd.sample(range(1, 30), 4)))
        counts = np.array([rnd.randrange(4) for _ in sizes])
        budget = rnd.randrange(120)
        take = m.closest_subset(sizes, counts, budget)
        assert (take <= counts).all() and (sizes * take).sum() == best_sum(sizes, counts, budget)


def test_fit_large_budgets():
    rnd = np.random.default_rng(0)
    for target in (0.2, 0.9, 1.3, 1.999, 2.0):
        sizes = np.unique(rnd.integers(1, 20_000, 3000))
        counts = rnd.integers(1, 50, len(sizes))
        total = int((sizes * counts).sum())
        passes, take = m.fit(sizes, counts, target * total)
        assert (take <= counts).all() and abs(passes * total + (sizes * take).sum() - target * total) <= 1


def test_fit_takes_a_long_document_that_nearly_fills_the_rest():
    sizes, counts = np.array([98_000, 99_000, 100_000]), np.ones(3, np.int64)
    passes, take = m.fit(sizes, counts, 398_500)
    assert passes == 1 and take.tolist() == [0, 0, 1]


def test_rows_with_all_columns(make_docs):
    rows = docs_of(8, 200, ["a", "b", None]) + [(None, "no id here", "a"), (500, None, "a"), (501, "", "b"), (7, "same same", "b"), (7, "same same", "b")]
    docs = make_docs(rows, extra=("_row", "_key", "_c", "size"))
    out = m.mixed_rows(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    want = {}
    for r in m.mix(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.copies * r.size
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in want.items() if n}


def test_empty_table(make_docs):
    assert m.mix(make_docs([])).collect() == [] and m.mixed_rows(make_docs([])).collect() == []


def test_texts_without_words(make_docs):
    got = m.mix(make_docs([(1, None, "a"), (2, " ", "b")])).collect()
    assert len(got) == 2 and all(r.size == 0 and r.target == 0 for r in got)
