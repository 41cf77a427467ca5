import random

import numpy as np
import pytest

from skewlens.llm import ordinal as o


def numeric_loss(at, f, grades, weights, thresholds):
    n = len(grades)
    used = weights[f] != 0
    score = np.bincount(at[used], weights[f[used]], n) / np.maximum(np.bincount(at[used], minlength=n), 1)
    tail = np.c_[np.ones(n), o.tails(score, thresholds), np.zeros(n)]
    return -np.log(np.maximum(tail[np.arange(n), grades] - tail[np.arange(n), grades + 1], 1e-12)).mean()


def made(n, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    texts, grades = [], []
    for _ in range(n):
        g = rnd.randrange(3)
        t = rnd.choices(words, k=40) + rnd.choices([["junk", "spam"], ["rude", "nasty"], ["fine", "good"]][g], k=3)
        rnd.shuffle(t)
        texts.append(" ".join(t))
        grades.append(g)
    return texts, np.array(grades)


def test_held_out_accuracy():
    texts, grades = made(600, 1)
    weights, thresholds = o.fit(*o.features(texts), grades)
    assert (np.diff(thresholds) > 0).all()
    texts, grades = made(300, 2)
    tail = o.tails(o.scores(weights, texts), thresholds)
    assert ((tail >= 0.5).sum(axis=1) == grades).mean() > 0.95


def test_rare_words_of_one_grade_get_a_weight_and_strong_ones_are_not_diluted():
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(300)] + ["faint", "weak"]
    texts, grades = [], []
    for n in range(2000):
        g = 1 if n % 10 == 0 else rnd.choice([0, 2])
        t = rnd.choices(words[:300], k=40) + (["faint", "weak"] if rnd.random() < (0.3, 0.4, 0.5)[g] else [])
        t += ["insult"] if g == 1 and n % 200 == 0 else ["rude"] if g == 1 else ["junk"] if g == 0 else []
        texts.append(" ".join(t))
        grades.append(g)
    at, f = o.features(texts)
    strength = o.strengths(at, f, np.array(grades))
    weights, thresholds = o.fit(at, f, np.array(grades), strength=strength)
    assert weights[o.word_features("insult")[0]] != 0  # 10 of 200 texts of a grade
    assert np.count_nonzero(strength) <= 8
    kept = o.tails(o.scores(weights, ["word1 word2 insult", "faint weak word3 insult", "faint weak rude", "faint weak word3", "word4"], strength), thresholds)[:, 1] >= o.MIN_TAIL
    assert kept.tolist() == [False, False, False, True, True]


def test_fit_is_a_minimum():
    texts, grades = made(200, 3)
    at, f = o.features(texts)
    weights, thresholds = o.fit(at, f, grades)
    start = numeric_loss(at, f, grades, np.zeros(o.SIZE), np.log([0.5, 2.0]))
    best = numeric_loss(at, f, grades, weights, thresholds)
    assert best < 0.2 * start
    for shift in (-0.5, 0.5):
        assert numeric_loss(at, f, grades, weights, thresholds + shift) > best


def test_tails_are_ordered_and_sum_to_the_grade():
    t = o.tails(np.linspace(-30, 30, 50), np.array([-1.0, 2.0]))
    assert (t[:, 0] >= t[:, 1]).all() and (np.diff(t, axis=0) >= 0).all()


def test_on_given_tables(spark):
    """Documents with their own labels held out: low quality is found, good documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    grade = {r.doc_id: r.grade for r in o.grades(labels).collect()}
    out = o.classify(docs, labels.filter("doc_id % 3 <> 0")).collect()
    assert len(out) == docs.count()
    good = [r.kept for r in out if r.doc_id % 3 == 0 and grade.get(r.doc_id) == 2]
    low = [r.kept for r in out if r.doc_id % 3 == 0 and grade.get(r.doc_id) == 0]
    assert np.mean(good) > 0.85 and np.mean(low) < 0.4
    again = {r.doc_id: r.score for r in o.classify(docs.repartition(7), labels.filter("doc_id % 3 <> 0").repartition(3)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-5) for r in out)


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "some words"), (None, "some words"), (3, "some words"), (4, "x" * 300_000)], extra=("score", "grade", "h"))
    labels = spark.createDataFrame([(3, 1, None), (2, None, 1), (None, 1, 0), (99, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = o.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.expected_grade <= 2 for r in got)
    none = o.classify(docs, labels.limit(0)).collect()
    assert all(r.expected_grade == pytest.approx(1.0) and r.score == 0 for r in none)
    assert o.classify(docs.limit(0), labels).collect() == []


def test_sample_is_bounded(make_docs, spark):
    docs = make_docs([(i, f"word{i} text") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    weights, _ = o.train(docs, o.grades(labels), max_rated=2)
    assert np.count_nonzero(weights) <= o.TOP
