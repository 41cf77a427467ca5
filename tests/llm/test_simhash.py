import random
import re

import numpy as np
import pytest
import xxhash

from skewlens.llm import simhash as s


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items):
    """items: (doc_id, print) -> component per item."""
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in items:
        for j, b in items:
            if i < j and bin(a ^ b).count("1") <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "Ünï cödé Ä x y z", "a b c d", "w " * 70_000] + [
        " ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(2, 40)]
    assert [s.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    col = spark.createDataFrame([(t,) for t in ["a b c", "Ünï x"]], "t string").selectExpr("xxhash64(t) h").collect()
    assert [r.h & (2**64 - 1) for r in col] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in ["a b c", "Ünï x"]]


def near_prints(n, seed=1):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for p in out[: n // 3]:
        q = p
        for _ in range(rnd.randrange(1, 6)):
            q ^= 1 << rnd.randrange(64)
        out.append(q)
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    p = np.array(near_prints(200), np.uint64)
    found = {(q, j) for q, mask in s.within_radius(p, p, s.planes_of(p), radius) for j in np.flatnonzero(mask)}
    want = {(i, j) for i in range(len(p)) for j in range(len(p)) if int(p[i] ^ p[j]).bit_count() <= radius}
    assert found == want


def frame(spark, prints):
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    return spark.createDataFrame([(x,) for x in set(signed)], "fp bigint")


@pytest.mark.parametrize("tile", [s.TILE, 16])
def test_links_join_all_near_pairs(spark, tile):
    """Also where a bucket is cut into tiles: a crowd that shares three quarters of its bits."""
    prints = near_prints(150) + [0] + [1 << i for i in range(64)] + [3 << i for i in range(62)]
    prints = sorted(set(prints))
    roots = {r.node: r.root for r in s.components(s.candidate_links(frame(spark, prints), tile)).collect()}
    want = brute_groups(list(enumerate(prints)))
    groups = {}
    for i, p in enumerate(prints):
        signed = int(np.uint64(p).astype(np.int64))
        groups.setdefault(want[i], set()).add(roots.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain_is_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    assert {r.root for r in s.components(links).collect()} == {0}


def test_documents(make_docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(2000, None), (2001, " "), (2002, "")]
    got = {r.doc_id: r for r in s.near_duplicates(make_docs(rows, extra=("fp", "component_id", "root"))).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_groups(prints)
    for i, p in prints:
        assert got[i].fp & (2**64 - 1) == p and got[i].component_id == want[i]


def test_representatives_and_odd_rows(make_docs):
    t = " ".join(f"word{i}" for i in range(50))
    docs = make_docs([(3, t), (1, t), (7, t), (None, t), (None, None), (9, "other words here now"), (9, "other words here now")], extra=("_row", "_key", "fp"))
    out = s.keep_representatives(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "9", "None", "None"]
    found = s.near_duplicates(docs).collect()
    assert len(found) == 7 and all((r.component_id is None) == (r.doc_id is None) for r in found)


def test_empty_table(make_docs):
    assert s.near_duplicates(make_docs([])).collect() == []
    assert s.keep_representatives(make_docs([])).collect() == []
