import random

import numpy as np
import pytest

from skewlens.llm import decontaminate as d


def brute(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def words(rnd, n):
    return " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 8))) for _ in range(n))


def test_edit_distance_is_exact():
    rnd = random.Random(4)
    for _ in range(300):
        p, t = "".join(rnd.choices("abé", k=rnd.randrange(1, 80))), "".join(rnd.choices("abé", k=rnd.randrange(0, 60)))
        want = brute(p, t)
        assert min(d.distances(p, t), default=len(p)) == min(want, len(p)) or not t
        found = d.best_match(p, t, len(p))
        if found and t:
            k, s, e = found
            assert k == want and brute(p, t[s:e]) == k


def test_grams_and_windows_lose_nothing():
    text = "abcdefghijklé"
    g = d.grams(d.folded(text))
    assert len(g) == len(text) - 7 and int(g[0]).to_bytes(8, "little") == b"abcdefgh"
    assert (d.folded("aé中😀") == [(ord(c) ^ ord(c) >> 8) & 255 for c in "aé中😀"]).all()


def test_recall_on_edited_passages_and_no_false_rows():
    rnd, rng = random.Random(9), np.random.default_rng(9)
    items = [(i, words(rnd, rnd.randrange(8, 90))) for i in range(60)]
    index = d.Index(items)
    texts, want = [], {}
    for n in range(150):
        i, item = items[n % len(items)]
        passage = item if n % 3 == 0 else d.edited(item, d.allowed(len(item)), rng)
        texts.append(words(rnd, 30) + " " + passage + rnd.choice(["", " ", "x "]) + words(rnd, 30))
        want[n] = item
    texts += [words(rnd, 200) for _ in range(60)]
    texts = [d.normalise(t) for t in texts]
    found = {}
    for t, i, dist, s, e in index.search(texts):
        item = index.texts[i]
        assert dist <= d.allowed(len(item)) and brute(item, texts[t][s:e]) == dist
        found.setdefault(t, set()).add(item)
    hits = [want[n] in found.get(n, ()) for n in want]
    assert np.mean(hits) >= 0.97 and all(hits[::3])
    assert not [t for t in found if t >= 150]


def test_recall_of_classes_with_one_item():
    """The promise holds for each class, however few its items, on edits that the calibration has not seen."""
    rnd, rng, hits = random.Random(12), np.random.default_rng(12), []
    for length in (45, 80, 150, 300):
        for _ in range(3):
            item = d.normalise(words(rnd, length))[:length].strip()
            index = d.Index([(1, item)])
            assert len(index.classes) == 1 and not index.classes[0].exact
            texts = [d.normalise(f"{words(rnd, 6)} {d.edited(item, d.allowed(len(item)), rng)} {words(rnd, 6)}") for _ in range(200)]
            found = {t for t, *_ in index.search(texts)}
            hits.append(len(found) / len(texts))
    assert min(hits) >= 0.96 and np.mean(hits) >= 0.985, hits


def test_confidence_needs_trials():
    assert d.surely(np.ones(100, bool)) < 0.99 < d.surely(np.ones(1000, bool))
    assert d.surely(np.arange(1000) >= 10) < 0.99 < d.surely(np.arange(20_000) >= 100)


def test_classes_are_built_by_tasks(spark):
    rnd = random.Random(5)
    items = [(i, words(rnd, rnd.randrange(8, 60))) for i in range(12)]
    block = d.Block(spark, items, d.MAX_EDIT_SHARE, 0.9)
    own, direct = block.index(), d.Index(items, recall=0.9)
    assert own.texts == direct.texts and [len(c.tables) for c in own.classes] == [len(c.tables) for c in direct.classes]
    for a, b in zip(own.classes, direct.classes):
        for (w, h, n, e), (x, i, m, f) in zip(a.tables, b.tables):
            assert (w.moves == x.moves).all() and (w.marks == x.marks).all() and (h == i).all() and (n == m).all() and e == f


def test_classes_that_tables_do_not_bring_to_the_recall_lose_nothing(monkeypatch):
    monkeypatch.setattr(d, "MAX_TABLES", 3)  # as 256 for items of thousands of characters
    rnd, rng = random.Random(3), np.random.default_rng(3)
    items = [(i, words(rnd, rnd.randrange(60, 240))) for i in range(40)] + [(40 + i, words(rnd, 5)) for i in range(5)]
    index = d.Index(items)
    assert any(c.exact for c in index.classes) and all(not c.tables for c in index.classes if c.exact)
    texts = [d.edited(item, d.allowed(len(item)), rng) + rnd.choice(["", " " + words(rnd, 40)]) for _, item in items]
    texts = [d.normalise(rnd.choice(["", words(rnd, 40) + " "]) + t) for t in texts] + [d.normalise(words(rnd, 400)) for _ in range(20)]
    monkeypatch.setattr(d, "PIECE_CHARS", 5000)
    found = {}
    for t, i, dist, s, e in index.search(texts):
        assert dist <= d.allowed(len(index.texts[i])) and brute(index.texts[i], texts[t][s:e]) == dist
        found.setdefault(t, set()).add(index.texts[i])
    long = [n for n, (_, item) in enumerate(items) if any(c.exact and c.low <= len(d.normalise(item)) <= c.high for c in index.classes)]
    assert len(long) >= 30 and all(d.normalise(items[n][1]) in found.get(n, ()) for n in long)
    assert not [t for t in found if t >= len(items)]


def test_equals_brute_force_on_given_tables(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in d.find_leaks(small, items).collect()}
    bench = [(r.item_id, d.normalise(r.text)) for r in items.collect()]
    want = {}
    for r in small.collect():
        t = d.normalise(r.text)
        for i, b in bench:
            if b in t:
                want[r.doc_id, i] = 0
    assert want and {k: v for k, v in got.items() if v == 0} == want


PASSAGE = "This is a passage of the benchmark that is long enough, to be found anywhere it is put"


def test_odd_rows(spark, make_docs):
    items = spark.createDataFrame([(1, PASSAGE, "q"), (2, None, "q"), (3, "too short", "q"), (4, PASSAGE.upper(), "q"), (None, PASSAGE + "?", "q")], "item_id bigint, text string, doc_id string")
    long = words(random.Random(1), 30_000)
    rows = [(1, f"before {PASSAGE.replace(' ', '  ')} after"), (2, None), (3, ""), (None, f"x{PASSAGE}"), (5, "too short"), (6, long + PASSAGE + long), (1, PASSAGE), (7, PASSAGE[:40])]
    docs = make_docs(rows, extra=("item_id", "_row", "_text", "distance"))
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in d.find_leaks(docs, items).collect())
    assert [x for x in got if x[1] == "1"] == [("1", "1", 0), ("1", "1", 0), ("6", "1", 0), ("None", "1", 0)]
    assert {x[1] for x in got} == {"1", "4", "None"} and {x[0] for x in got} == {"1", "6", "None"}
    clean = d.clean_rows(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 7]


def test_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "item_blocks", lambda items: iter([[(1, PASSAGE)], [(2, PASSAGE[::-1])]]))
    docs = make_docs([(1, PASSAGE), (2, PASSAGE[::-1]), (3, "neither of them")])
    assert sorted((r.doc_id, r.item_id) for r in d.find_leaks(docs, None).collect()) == [(1, 1), (2, 2)]
    assert [r.doc_id for r in d.clean_rows(docs, None).collect()] == [3]


def test_items_come_in_bounded_blocks(spark):
    items = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "item_id bigint, text string")
    assert [len(b) for b in d.item_blocks(items, most=250)] == [3, 3, 3, 1]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    assert d.find_leaks(make_docs([(1, PASSAGE)]), none).collect() == []
    assert d.find_leaks(make_docs([]), some).collect() == []
    assert d.clean_rows(make_docs([(1, PASSAGE)]), none).count() == 1
    assert d.clean_rows(make_docs([]), some).count() == 0


@pytest.mark.parametrize("length", [20, 100, 400])
def test_copies_agree_in_a_table(length):
    rnd = random.Random(length)
    texts = [words(rnd, 200)[:length] for _ in range(20)]
    texts = [d.normalise(t) for t in texts]
    c = d.LengthClass(texts, list(range(20)), d.MAX_EDIT_SHARE, d.TARGET_RECALL)
    chars, starts = d.padded([t + words(rnd, 300) for t in texts], "\0" * length)
    found = np.zeros(20, bool)
    for walk, hashes, numbers, every in c.tables:
        if not every:
            continue
        h = walk.hashes(chars, starts)
        found |= np.array([numbers[np.flatnonzero(hashes == x)].tolist().count(i) > 0 for i, x in enumerate(h)])
    assert found.all()


def test_walks_take_little_memory():
    """What a worker keeps of a class: 46 MB for these items when every move took eight bytes."""
    rnd = random.Random(6)
    texts = [d.normalise(words(rnd, 120))[:300 + i].strip() for i in range(20)]
    walks = [w for w, *_ in d.LengthClass(texts, list(range(20)), d.MAX_EDIT_SHARE, d.TARGET_RECALL).tables]
    assert sum(a.nbytes for w in walks for a in vars(w).values() if isinstance(a, np.ndarray)) < 8e6


def test_rows_go_to_the_workers_with_one_text(spark, make_docs):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    docs = make_docs([(1, f"x {PASSAGE}"), (2, "clean"), (3, None)]).withColumnRenamed("text", "Text")
    clean = d.clean_rows(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert "AS _text" not in clean._jdf.queryExecution().optimizedPlan().toString()


def test_walks_that_have_met_are_walked_once():
    class Counted(np.ndarray):
        taken = 0

        def take(self, at, **kwargs):
            Counted.taken += len(at)
            return np.asarray(self).take(at, **kwargs)

    chars = d.folded(words(random.Random(8), 1500)[:4000]).astype(np.intp)
    walk, starts = d.Walk(300, 1, 4), np.r_[0:1500, 1700:3300:3]
    want = np.concatenate([walk.hashes(chars, starts[i:i + 1]) for i in range(len(starts))])
    assert (walk.hashes(chars.view(Counted), starts) == want).all()
    assert Counted.taken < 0.3 * len(starts) * len(walk.moves)


def test_windows_that_repeat_a_word_are_left_out_and_none_is_lost(monkeypatch):
    seen, add = set(), d.Open.add

    def noted(self, *args):
        before = len(self.at)
        add(self, *args)
        seen.update((int(t), int(p)) for ts, ps in zip(self.text[before:], self.position[before:]) for t, p in zip(ts, ps))

    monkeypatch.setattr(d.Open, "add", noted)
    rnd, rng = random.Random(2), np.random.default_rng(2)
    once = words(rnd, 12) + " the the the " + words(rnd, 12)
    list(d.Index([(1, once)]).candidates(["the " * 2000]))
    assert not seen
    # items of few words, some of one only: every edited passage starts a window
    few = ["the", "of", "the of", "a", "thor thor thor"]
    items = [" ".join(rnd.choice(few) for _ in range(rnd.randrange(15, 50))) for _ in range(20)] + ["the " * 24 + "the", "x" * 300]
    before = [rnd.choice(["the " * 30, "of the " * 9, words(rnd, 9) + " "]) for _ in range(3 * len(items))]
    texts = [b + d.edited(items[n % len(items)], n // len(items) * d.allowed(len(items[n % len(items)])) // 2, rng) + " the" * 20 for n, b in enumerate(before)]
    list(d.Index(list(enumerate(items))).candidates(texts))
    assert {(n, len(b)) for n, b in enumerate(before)} <= seen
