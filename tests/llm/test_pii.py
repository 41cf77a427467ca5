import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skewlens.llm import pii as p

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(digits) <= 19 and p.luhn(digits), 8 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_equals_plain_patterns():
    rnd = random.Random(1)
    parts = ["a", ".", "@", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "x@y.z", "+1 (743) 555-3824", "1.2.3.4", "é", "\n", "００", "_%"]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        assert p.base_spans(t) == brute(t), t


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "a@" * 100_000, "+1 " + "(" * 300_000, "1 " * 200_000, "@" * 100_000])
def test_long_runs_take_linear_time(text):
    spans = p.base_spans(text)
    p.tokens(text, spans)


def exact(node, edges, pair):
    """Marginals by summing over all labelings."""
    n = len(node)
    total = np.zeros((n, p.LABELS))
    for y in itertools.product(range(p.LABELS), repeat=n):
        w = np.exp(sum(node[i, y[i]] for i in range(n)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(n):
            total[i, y[i]] += w
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(0)
    for edges, tolerance in ((np.array([[0, 1], [1, 2], [1, 3]]), 1e-2), (np.array([[0, 1], [1, 2], [2, 3], [0, 3]]), 0.1)):
        node, pair = rng.normal(size=(4, p.LABELS)), rng.normal(size=(len(edges), p.LABELS, p.LABELS)) * 0.5
        pair = (pair + pair.transpose(0, 2, 1)) / 2
        b = p.beliefs(node, edges, pair)
        b = np.exp(b - b.max(axis=1, keepdims=True))
        assert np.abs(b / b.sum(axis=1, keepdims=True) - exact(node, edges, pair)).max() < tolerance


def test_edges_are_linear_in_the_tokens():
    text = "a@b.cc " + "5551234567 " * 500
    b = next(p._read([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))
    g = p.Graph(b)
    assert len(g.edges) <= 3 * len(g.doc)


def test_labels_reach_every_occurrence():
    """Equal tokens hang on the first one: agreement does not end after a number of rounds."""
    text = "call +1 (743) 555-3824 now" + " ; 555-3824 or so" * 300
    g = p.Graph(next(p._read([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
    node, pairs = np.zeros((p.SHAPES, p.LABELS)), np.ones((3, p.LABELS, p.LABELS))
    pairs[1:] += 200 * np.eye(p.LABELS)
    _, edge = p.potentials(np.ones((p.SHAPES, p.LABELS)), pairs)
    got = p.added(g, node, edge)
    assert len(got) == 300 and {k for _, k, _, _ in got} == {3}


def test_whole_shapes_and_wide_gaps():
    a, b = "1-" * 60 + "1", "1-" * 60 + "1a"
    assert p.shape(a) != p.shape(b) and len(p.shape("x1" * 100)) > 200
    near, far = (p.tokens(f"12345{gap}67890", []) for gap in (" ", " " * 5000))
    assert [t[6] for t in near] == [t[6] for t in far] == [False, True]


PHONE = "+1 (310) 555-4510"


def test_agreement_adds_spans_within_a_document_only(make_docs):
    spread = [(i, f"call me at {PHONE[:-1]}{i % 10} or write to some.one{i}@example.com today") for i in range(60)]
    told = f"call {PHONE} soon. Later he said 555-4510 again, and in 1999 there were 12 of 4510 left"
    rows = spread + [(100, told), (101, "nobody said 555-4510 before, in 1999"), (102, None), (103, "")]
    got = {r.doc_id: r for r in p.find_personal_data(make_docs(rows, extra=("spans", "key"))).collect()}
    at = told.rindex("555-4510")
    assert f"phone:{at}:{at + 8}" in got[100].spans and got[100].n_added == 1
    assert got[101].spans == "" and got[102].spans == "" and got[103].base == ""
    assert all(got[i].spans == got[i].base and got[i].n_phone == got[i].n_email == 1 for i in range(60))
    assert p.masked(told, got[100].spans).count("<phone>") == 2


def test_every_document_is_counted():
    texts = ["x@y.zz and 12345678 or 12345678", None, "12345678 again 12345678", "no digits", "2024 2024"]
    read = list(p._read([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])]))
    assert [len(x) for x in read[0].column(2).to_pylist()] == [3, 0, 0, 0, 0]
    got = {(t, r, c): n for b in p._count(read) for t, r, c, n in zip(*(x.to_pylist() for x in b.columns))}
    bucket = {t[1] - t[0]: t[3] for t in p.tokens("12345678 2024", [])}
    assert got[3, bucket[8], 0] == 4 and got[3, bucket[4], 0] == 2
    assert got[1, 0, 0] == 4  # two edges of equal tokens, in both directions


def test_only_tokens_linked_to_a_base_token_are_free():
    text = "x@y.zz said 4111111111111112 and 4111111111111112 and x@y.zz"
    g = p.Graph(next(p._read([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
    node = np.zeros((p.SHAPES, p.LABELS))
    node[:, 3] = 5  # cards, by their shape
    assert p.added(g, node, np.zeros((3, p.LABELS, p.LABELS))) == []
    edges = np.array([[0, 1], [3, 2], [1, 2], [5, 6]])
    assert p.linked(8, edges, np.arange(8) == 3).tolist() == [True] * 4 + [False] * 4


def test_base_columns_of_the_query(spark, small):
    from skewlens.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op1_skip_chain_pii"](spark, "/root/testdata/sf0.001").collect()}
    for r in small.collect():
        want = brute(r.text)
        text = ",".join(f"{p.KINDS[k]}:{s}:{e}" for k, s, e in want)
        q = got[r.doc_id]
        assert q.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [q.n_email, q.n_ip, q.n_card, q.n_phone] == [sum(k == x for x, _, _ in want) for k in range(4)]
        assert set(text.split(",")) <= set(q.spans.split(","))


def test_repeated_and_null_rows_and_empty_table(make_docs):
    docs = make_docs([(None, "x@y.zz"), (1, "x@y.zz"), (1, "x@y.zz")])
    assert sorted(str(r.doc_id) for r in p.find_personal_data(docs).collect()) == ["1", "1", "None"]
    assert p.find_personal_data(make_docs([])).collect() == []
