import random
import zlib

import numpy as np
import pytest

from skewlens.llm import token_files as f

TEXTS = [
    "Hello world, it's 2024!", None, "", "  \n\t ", "naïve café   x y", "a\x1cb \x1f c", "it's<|endoftext|>not the end", "don't DON'T 'll x'd 12 345",
    "Ünïcödé ΑΣ ΣΑΣ İstanbul é é", "中文 字符 😀😀 x", "w" * 5000, "abc " * 3000, "x́ ́y", "<|startoftext|>", "a\u0085b​c",
]


def encoded(text):
    return f.encoder(f.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [f.END_ID]


def test_cached_words_equal_whole_texts(small):
    texts = TEXTS + [r.text for r in small.limit(40).collect()]
    enc = f.Encoder(f.default_tokenizer())
    for _ in range(2):  # cold and warm
        ids, counts = enc.encode_many([(t or "").encode() for t in texts])
        own = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in own] == [encoded(t) for t in texts]


def test_random_texts_and_full_tables(small):
    r = random.Random(4)
    marks = [*"abzABZ019 .,'-\t\n\r\x0b\x0c\x1c\x00\x7f", "é", "É", "ß", "ÿ", "×", "÷", "à", "\u0301", "\xa0", "\x85", "\u2009", "İ", "Σ", "中", "😀", "'s", "'LL"]
    texts = ["".join(r.choice(marks) for _ in range(r.randrange(40))) for _ in range(600)] + [t or "" for t in TEXTS]
    want = [encoded(t) for t in texts]
    for size in (1, 40, 1 << 20):
        enc = f.Encoder(f.default_tokenizer(), size)
        for _ in range(2):
            got = []
            for i in range(0, len(texts), 25):
                ids, counts = enc.encode_many([t.encode() for t in texts[i:i + 25]])
                got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == want


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    table = f.Table("<u2", 500)
    keys = np.unique(np.r_[rng.integers(1, 1 << 64, 300, np.uint64), np.arange(1, 150, dtype=np.uint64)])  # small ones share a slot
    counts = rng.integers(0, 4, len(keys))
    ids = rng.integers(0, 1 << 16, counts.sum()).astype("<u2")
    table.add(keys[:200], ids[:counts[:200].sum()], counts[:200])
    table.add(keys[200:], ids[counts[:200].sum():], counts[200:])
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(np.array([7_000, 8_000], np.uint64)) == -1).all()
    got, lengths = table.look_up(np.arange(len(keys)))
    assert (got == ids).all() and (lengths == counts).all()


def test_round_trip(spark, make_docs, tmp_path):
    rows = [(i * 7 % 15, t) for i, t in enumerate(TEXTS)] + [(None, "last one"), (3, "same id"), (3, "same id"), (f.LAST, "the largest id")]
    folder = f"file://{tmp_path}/tokens"
    parts = f.write_tokens(make_docs(rows, extra=("part", "ids")), folder)
    got = f.read_tokens(spark, folder, parts, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [r[0] for r in order]
    for r, (_, text) in zip(by_start, order):
        want = encoded(text)
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert parts[-1][0] + parts[-1][2] == start


def test_files_are_flat_and_mapped(spark, make_docs, tmp_path):
    f.write_tokens(make_docs([(1, "one two"), (2, "three")]), str(tmp_path))
    everything = [x for p in range(len(list(tmp_path.glob("ids-*.bin")))) for x in f.mapped(str(tmp_path), p, "<u2")[0].tolist()]
    assert everything == encoded("one two") + encoded("three")
    assert not list(tmp_path.glob("_*"))


def test_empty_table(make_docs, tmp_path):
    assert f.token_files(make_docs([]), str(tmp_path)).collect() == []


@pytest.mark.parametrize("address, path", [("/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("file:/a/b", "/a/b")])
def test_folders(address, path):
    assert f.open_folder(address)[1] == path


def test_idle_workers_hold_what_they_keep_only(spark, monkeypatch):
    """Workers wait beside the tasks of later stages: what a task has freed must not stay with them."""
    from pyspark.sql import functions as F

    def freed_by(batches):
        """MB that a worker holds and could give back to the system."""
        import ctypes
        import re

        import pyarrow as pa

        def held():
            with open("/proc/self/smaps_rollup") as m:
                return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", m.read()))) / 1024

        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([before - held()])], ["mb"])

    monkeypatch.setitem(spark.sparkContext.environment, "SKEWLENS_TEST_WORKERS", "own")  # workers that no other test has used
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.translate(F.substring(F.hex(F.xxhash64("id", i)), 1, 4), "0123456789", "ghijklmnop"))
    monkeypatch.setattr(f, "partitions", lambda spark: 2)
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    assert f.token_files(docs).count() == 24_000
    freed = [r.mb for r in spark.range(0, 2, 1, 2).mapInArrow(freed_by, "mb double").collect()]
    assert max(freed) < 20, freed
