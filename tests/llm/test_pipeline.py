"""Every stage of the pipeline against brute force, on the given documents and on odd rows."""

import importlib
import zlib
from collections import Counter

import numpy as np
import pytest
from test_mixing import brute_targets
from test_quality_rules import brute as brute_counts
from test_simhash import brute_groups, brute_print

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from skewlens.llm import decontaminate, token_files

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows):
    out = []
    for r in rows:
        n, _, _, _, repeats = brute_counts(r.text)
        if n >= 10 and 100 * repeats <= 20 * n:
            out.append(r)
    return out  # no host of these tables fails half its documents


def representatives(rows):
    groups = brute_groups([(r.doc_id, brute_print(r.text)) for r in rows])
    return [r for r in rows if groups[r.doc_id] == r.doc_id]


def clean(rows, bench):
    items = [decontaminate.normalise(r.text) for r in bench]
    return [r for r in rows if not any(i in decontaminate.normalise(r.text) for i in items)]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = docs.collect()
    frame, seen = docs, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = frame.collect()
        if name != "token_files":
            assert frame.columns == docs.columns
    by_id = lambda rs: sorted(rs, key=lambda r: r.doc_id)
    want = kept_by_rules(rows)
    assert by_id(seen["quality_rules"]) == by_id(want) and len(want) < len(rows)
    want = representatives(want)
    assert by_id(seen["simhash_near_dedup"]) == by_id(want)
    want = clean(want, bench)
    assert by_id(seen["decontamination"]) == by_id(want) and len(want) < len(seen["simhash_near_dedup"])
    copies = Counter(seen["mixing"])
    assert set(copies) <= set(want) and max(copies.values()) <= 2
    sizes, words = Counter(), Counter()
    for r in want:
        sizes[r.source] += len(r.text.split())
        words[r.source] += copies[r] * len(r.text.split())
    for source, target in brute_targets(dict(sizes)).items():
        longest = max(len(r.text.split()) for r in want if r.source == source)
        assert target - longest <= words[source] <= target + 1
    start = 0
    tokens = sorted(seen["token_files"], key=lambda r: r.start)
    for r, d in zip(tokens, sorted(seen["mixing"], key=lambda r: (r.doc_id, r.text)), strict=True):
        ids = token_files.encoder(token_files.default_tokenizer()).tokenizer.encode(d.text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (3, "a few words"), (3, "a few words"), (None, "x" * 100_000)]])
def test_odd_tables_pass_every_stage(spark, make_docs, tmp_path, rows):
    frame = make_docs(rows + [(10 + i, " ".join(f"word{i}x{j}" for j in range(20)), s) for i, s in enumerate("ab") if rows])
    for name, stage in pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    assert (frame.count() > 0) == bool(rows)


def test_registered(spark):
    assert entry.queries()["pipeline"] is pipeline.run and "pipeline" not in entry.oracle_sql()
    assert sorted(n.split("_")[0] for n in entry.queries() if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))


def test_run_equals_its_stages(spark):
    out = pipeline.run(spark, SF).collect()
    assert out and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(out[0].asDict())


def test_rest_stands_without_the_package(monkeypatch):
    """The entry without this package: the other queries stay."""
    import builtins
    import sys

    real = builtins.__import__

    def missing(name, *args, **kw):
        if name.startswith("skewlens.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", missing)
        for k in [k for k in sys.modules if k.startswith("skewlens.llm") or k in ("corpus_pipeline", "__spark_entry__")]:
            m.delitem(sys.modules, k)
        alone = importlib.import_module("__spark_entry__")
        assert "validation" in alone.queries() and not [q for q in alone.queries() if q.startswith("op")] and "pipeline" not in alone.queries()
        m.delitem(sys.modules, "__spark_entry__")
