import hashlib
import random

import pyarrow as pa

from skewlens.llm import line_dedup as l

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    owners = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(l.LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == (l.LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(make_docs, rows, **more):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in l.dedup_lines(make_docs(rows, extra=("id", "hi", "drops")), **more).collect()), key=str)


def sample():
    rnd = random.Random(7)
    lines = [f"This is Line number {i} é" for i in range(25)] + ["short", "", "  ", "\tTHIS IS line NUMBER 3 é \x0c", "ÀÉ this stays long", "àé this stays long"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(8)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, "unique line of its own\n" * 3), (73, "x" * 200_000), (74, "x" * 200_000), (None, lines[3] + "\nonly here, no id"), (5, lines[4]), (5, lines[4])]


def test_equals_brute_force(make_docs):
    assert run(make_docs, sample()) == brute(sample())


def test_full_filter_only_costs_time(make_docs):
    """With a filter far too small every line is suspected, and the result is the same."""
    rows = [(i, "\n".join(f"a line that is number {(i * 7 + j) % 900}" for j in range(40))) for i in range(100)]
    assert run(make_docs, rows, max_cells=l.BLOCK) == brute(rows)


def test_twice_filter_holds_every_repeat_and_few_others(make_docs, spark):
    rows = [(i, f"only in document {i}\nshared by pairs {i // 2}") for i in range(2000)]
    docs = make_docs(rows).select("doc_id", "text")
    cells = 1 << 16
    bits = spark.sparkContext.broadcast(l.twice_filter(docs, cells))
    found = docs.mapInArrow(l._suspects(bits, cells), "hi bigint, lo bigint, id bigint").collect()
    want = {(r.hi, r.lo) for r in found}
    _, _, _, shared = l.line_keys(pa.array([f"shared by pairs {i}" for i in range(1000)]))
    assert {tuple(x) for x in shared.astype("int64").tolist()} <= want
    assert len(want) < 1000 + 0.05 * 2000


def test_ranges_of_digests_keep_filters_sparse(make_docs, spark):
    """More lines than a filter is made for: each range has a filter of its own, and few lines are suspected."""
    rows = [(i, "\n".join(f"line {j} of document {i} alone" for j in range(30)) + f"\nshared by pairs {i // 2}") for i in range(800)]
    docs, cells, parts = make_docs(rows).select("doc_id", "text"), l.BLOCK, 6
    found = []
    for part in range(parts):
        bits = spark.sparkContext.broadcast(l.twice_filter(docs, cells, part, parts))
        found += docs.mapInArrow(l._suspects(bits, cells, part, parts), "hi bigint, lo bigint, id bigint").collect()
    assert len(found) == len(set(found)) and 800 <= len(found) < 800 + 0.05 * 24_000
    whole = spark.sparkContext.broadcast(l.twice_filter(docs, cells))
    assert docs.mapInArrow(l._suspects(whole, cells), "hi bigint, lo bigint, id bigint").count() > 3 * len(found)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    assert sum(len(l.pairs(batch, i, 6)) for i in range(6)) == len(l.pairs(batch))
    for passes in (1, 4):
        assert run(make_docs, rows[:200], max_cells=l.BLOCK // 8, max_passes=passes) == brute(rows[:200])


def test_empty_table(make_docs):
    assert run(make_docs, []) == []


def test_query_digest(spark):
    from skewlens.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, dropped, text in brute(docs):
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())
