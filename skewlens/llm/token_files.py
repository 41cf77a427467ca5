"""Token ids in flat binary files with 64-bit document offsets.

Format. Part p of a set has ``ids-p.bin`` (all its token ids, little-endian
unsigned 16 or 32 bits, nothing else), ``offsets-p.bin`` (unsigned 64 bits: where
each document starts within the part, and the end) and ``docs-p.bin`` (signed 64
bits: the doc_id of each document). Parts are in ascending doc_id order; a
part's base is the sum of the ids in the parts before it. Files can be mapped
into memory as they are.

Tasks write straight to a folder that all executors reach, through the file
system its address names, under a name of their own that is renamed at the end:
a task that runs twice leaves the same file. The driver sees two numbers per part.

The pre-tokenizer never joins text across white space, nor letters with digits or
marks, so texts are cut there first, many at once on their bytes. Each piece is
encoded by the tokenizer once per worker and found by a 64-bit image after that, in
flat tables of bounded size; the ids are those of the whole text. A text that holds
one of the tokenizer's special strings is encoded whole.

Defined cases. A null text is empty and has the end id only. Documents with a
null doc_id come last and are written with the largest signed id, and each part is
returned with their number; those with equal ids follow the order of their texts. An empty table gives an empty set.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from skewlens.session import shared_folder

from .common import column, giving_back, partitions
from .phrases import word_images

END_ID = 1
LAST = (1 << 63) - 1
CHUNK = 2 << 20       # bytes of text encoded at once
PART_BYTES = 128 << 20  # of text in a file, at most some of these
CACHED_PIECES = 1 << 20  # in each of the two generations of a worker's table

# Bytes of plain words: ASCII marks but ' (which may start a contraction), letters and digits, and Latin-1 letters, whose
# first byte is always the same. The pre-tokenizer parts such words where letters, digits and marks meet.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[np.r_[48:58]] = _DIGIT
_KIND[np.r_[65:91, 97:123, 128:192, 195]] = _LETTER
_ODD = np.ones(256, bool)
_ODD[np.r_[9:14, 32:39, 40:127, 128:192, 195]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Far apart: a seed is crossed with the length of the piece.
_PLAIN_SEED, _ODD_SEED = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
# Byte-level models name a byte beyond ASCII that prints in Latin-1 by its own character, others by those from 256 on, in order.
_BYTE_NAMES = {b: 256 + 34 + b - 128 for b in range(128, 161)} | {173: 256 + 67}

_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Table:
    """64-bit images of pieces with their ids: open addressing in flat arrays, 20 bytes a piece and its ids."""

    def __init__(self, dtype: str, size: int):
        bits = (2 * size - 1).bit_length()
        self.size, self.shift, self.mask = size, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.empty(1 << bits, np.int32)
        self.ids, self.starts = np.empty(0, dtype), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not held."""
        out, at, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.numbers[slot[hit]]
            go = ~hit & (held != 0)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New keys, each once, with their ids."""
        numbers, slot = np.arange(len(self), len(self) + len(keys), dtype=np.int32), (keys >> self.shift).astype(np.int64)
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.numbers[slot[own]] = keys[own], numbers[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, numbers, slot = keys[left], numbers[left], (slot[left] + 1) & self.mask

    def look_up(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each has)."""
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(n) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)], lengths


class Encoder:
    """Whole texts to ids through the pieces that the pre-tokenizer makes of them, each encoded once and kept.

    The table has two generations: when the newer is full, the older goes, and pieces that
    are met again move to the new one. A word with a byte that is not plain is a piece as it is.
    """

    def __init__(self, path: str, size: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        shape = json.loads(self.tokenizer.to_str())
        last = ((shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[-1]
        # Plain pieces are in normal form and need no further cuts: the model takes their bytes as they are.
        self.straight = last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.size = size
        self.young, self.old = Table(self.dtype, size), Table(self.dtype, 1)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn(self, keys: np.ndarray, strings, room: int) -> None:
        """Ids of new pieces, from the older generation or the tokenizer; ``strings`` gives the bytes of those at given places.

        A new generation holds ``room`` pieces at least.
        """
        if len(self.young) + len(keys) > self.size:
            self.old, self.young = self.young, Table(self.dtype, max(self.size, room))
        known = self.old.find(keys)
        again = known >= 0
        if again.any():
            self.young.add(keys[again], *self.old.look_up(known[again]))
        at = np.flatnonzero(~again)
        for i in range(0, len(at), 20_000):
            part = at[i:i + 20_000]
            texts, plain = strings(part)
            if self.straight:
                tokenize = self.model.tokenize
                named = [x.decode() if x.isascii() else x.decode("latin-1").translate(_BYTE_NAMES) for x, p in zip(texts, plain) if p]
                own = [[t.id for t in tokenize(x)] for x in named]
                self.young.add(keys[part[plain]], np.array(list(chain.from_iterable(own)), self.dtype), np.array([len(x) for x in own], np.int64))
                part, texts = part[~plain], [x for x, p in zip(texts, plain) if not p]
            enc = self.tokenizer.encode([x.decode() for x in texts], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(part))
            self.young.add(keys[part], np.array(enc.ids, self.dtype), counts)

    def pieces(self, texts: list[bytes]):
        """(images of the pieces of all texts, text of each, function that gives their bytes and whether they are plain)."""
        raw = b" ".join(texts) + b" " * 8
        chars = np.frombuffer(raw, np.uint8)
        kind = _KIND[chars]
        inside = kind != _SPACE
        turns = np.flatnonzero(np.diff(inside, prepend=False)).reshape(-1, 2)  # the end is a blank: words are closed
        first = np.flatnonzero(chars == 0xC3) + 1
        second = chars[first]
        odd = _ODD[chars]
        odd[first[(second == 0x97) | (second == 0xB7)]] = True  # the signs for times and divided
        upto = np.r_[0, np.cumsum(odd, dtype=np.int32)]
        apart = turns[upto[turns[:, 1]] > upto[turns[:, 0]]]  # words that are not plain
        begins = inside & ((np.diff(kind, prepend=np.uint8(_SPACE)) != 0) | (kind == _DIGIT))
        if len(apart):
            edges = np.zeros(len(chars) + 1, np.int8)
            edges[apart[:, 0]] = 1
            edges[apart[:, 1]] = -1
            begins &= ~(np.cumsum(edges[:-1], dtype=np.int8) > 0)
            begins[apart[:, 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True]) + 1
        low = _LOWER[chars]
        low[first[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
        low, lengths = low.tobytes(), ends - starts
        keys = word_images(low, starts, lengths, np.full(len(starts), _PLAIN_SEED))
        unlike = np.zeros(len(starts), bool)
        unlike[np.searchsorted(starts, apart[:, 0])] = True
        own = np.flatnonzero(unlike)
        keys[own] = word_images(raw, starts[own], lengths[own], np.full(len(own), _ODD_SEED))
        keys[keys == 0] = 1
        text = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), starts, "right") - 1

        def spelled(at):
            return [(raw if u else low)[s:e] for u, s, e in zip(unlike[at].tolist(), starts[at].tolist(), ends[at].tolist())], ~unlike[at]

        return keys, text, spelled

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text) with the end id after each text."""
        special = {i: self.whole(t.decode()) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        keys, text, spelled = self.pieces([b"" if i in special else t for i, t in enumerate(texts)])
        numbers = self.young.find(keys)
        if (numbers < 0).any():
            missed = np.flatnonzero(numbers < 0)
            new, place = np.unique(keys[missed], return_index=True)
            before = self.young
            self.learn(new, lambda at: spelled(missed[place[at]]), len(keys))
            if self.young is not before:  # a new generation: what it lacks of these texts moves over
                lost = np.flatnonzero(self.young.find(keys) < 0)
                back, place = np.unique(keys[lost], return_index=True)
                self.young.add(back, *self.old.look_up(self.old.find(back)))
            numbers = self.young.find(keys)
        ids, lengths = self.young.look_up(numbers)
        counts = np.bincount(text, lengths, len(texts)).astype(np.int64) + 1
        if special:
            own = np.split(ids, np.cumsum(counts - 1)[:-1])
            own = [special.get(i, x) for i, x in enumerate(own)]
            counts = np.array([len(x) + 1 for x in own])
            ids = np.concatenate(own)
        ends = np.cumsum(counts) - 1
        out = np.empty(len(ids) + len(texts), self.dtype)
        out[ends] = END_ID
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = ids
        return out, counts


def encoder(path: str) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def open_folder(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given as a path or as scheme://..."""
    if "://" in address or address.startswith("file:"):
        if urlparse(address).scheme == "file":
            return pafs.LocalFileSystem(), urlparse(address).path
        return pafs.FileSystem.from_uri(address)
    return pafs.LocalFileSystem(), os.path.abspath(address)


def chunks(batches):
    """(doc_ids, texts as bytes) of some ``CHUNK`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        raw = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), raw):
            ids.append(doc_id)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write(folder: str, tokenizer: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        fs, root = open_folder(folder)
        enc, mark = encoder(tokenizer), uuid.uuid4().hex
        names = [f"{root}/{kind}-{part:06d}.bin" for kind in ("ids", "offsets", "docs")]
        own = [f"{root}/_{kind}-{part:06d}-{mark}" for kind in ("ids", "offsets", "docs")]
        fs.create_dir(root, recursive=True)
        total = docs = nulls = 0
        with fs.open_output_stream(own[0]) as a, fs.open_output_stream(own[1]) as b, fs.open_output_stream(own[2]) as c:
            for doc_ids, texts in chunks(batches):
                ids, counts = enc.encode_many(texts)
                a.write(ids.tobytes())
                b.write((total + np.cumsum(counts) - counts).astype("<u8").tobytes())
                c.write(np.array([LAST if i is None else i for i in doc_ids], "<i8").tobytes())
                total += int(counts.sum())
                docs += len(texts)
                nulls += doc_ids.count(None)
            b.write(np.array([total], "<u8").tobytes())
        for x, y in zip(own, names):
            fs.move(x, y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32())] + [pa.array([x], pa.int64()) for x in (docs, total, nulls)], ["part", "docs", "ids", "nulls"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, int]]:
    """Write ``docs`` to ``folder`` and return (base, documents, ids, documents without doc_id) for each part, in order."""
    spark = docs.sparkSession
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    size = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, partitions(spark), size // PART_BYTES)
    order = F.col("doc_id").asc_nulls_last()
    # rows that share an id, or have none, are dealt by the start of their text
    ranged = d.repartitionByRange(n, order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
    rows = ranged.mapInArrow(giving_back(_write(folder, tokenizer or default_tokenizer())), "part int, docs bigint, ids bigint, nulls bigint").collect()
    out, base = [], 0
    sizes = {r[0]: tuple(r)[1:] for r in rows}
    for p in range(max(sizes, default=-1) + 1):
        docs_here, ids_here, nulls = sizes.get(p, (0, 0, 0))
        out.append((base, docs_here, ids_here, nulls))
        base += ids_here
    return out


def mapped(folder: str, part: int, dtype: str):
    """(ids, offsets, doc_ids) of a part: mapped into memory from a local or mounted folder, else read."""
    fs, root = open_folder(folder)
    arrays = []
    for kind, kind_type in (("ids", dtype), ("offsets", "<u8"), ("docs", "<i8")):
        name = f"{root}/{kind}-{part:06d}.bin"
        if isinstance(fs, pafs.LocalFileSystem):
            arrays.append(np.memmap(name, kind_type, mode="r") if os.path.getsize(name) else np.empty(0, kind_type))
        else:
            with fs.open_input_file(name) as f:
                arrays.append(np.frombuffer(f.read(), kind_type))
    return arrays


def _read(folder: str, parts: list[tuple[int, int, int, int]], dtype: str, with_ids: bool):
    def run(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                ids, offsets, docs = mapped(folder, part, dtype)
                base, nulls = parts[part][0], np.arange(len(docs)) >= len(docs) - parts[part][3]  # they come last
                for i in range(0, len(docs), 1024):
                    at = offsets[i:i + 1025].astype(np.int64)
                    own = [ids[s:e] for s, e in zip(at[:-1], at[1:])]
                    columns = [
                        pa.array(np.array(docs[i:i + 1024], np.int64), mask=nulls[i:i + 1024]), pa.array(at[:-1] + base), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32).tolist() for x in own], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files; one task per part."""
    dtype = encoder(tokenizer or default_tokenizer()).dtype
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(giving_back(_read(folder, parts, dtype, with_ids)), schema)


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back; ``folder`` must be reachable by all executors (default: below the shared folder)."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens"
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer, id_col, text_col), tokenizer)
