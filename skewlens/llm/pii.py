"""Personal data by patterns and a skip-chain conditional random field.

Base. Four fixed patterns give email, ip, card and phone spans, leftmost and not
overlapping within a kind; a match that fails its test is dropped.

Field. The nodes are the tokens (runs without white space) that hold a digit or
an @; all other tokens can only be "none" and drop out. A token on a base span
is held to its kind. Edges join neighbouring tokens of the text (chain), tokens
with the same content anywhere in the document (skip), and similar ones: equal
last seven digits, equal part before the @ (skip). The edges of equal tokens run
from the first occurrence to each other one: there are never more edges than tokens,
and any two occurrences are two messages apart, however many there are.

Weights, by piecewise training on all documents: a token's potential is the log
share of each label among tokens of its shape; an edge's potential is the log of
how much more often two labels meet on such edges than by chance. Documents without a
base span are counted where they are read; their tokens are not kept, since none of
them can be decoded as a kind. The counts are summed by Spark; the driver sees a
bounded table (shapes are hashed).

Inference. Loopy sum-product message passing, damped, over all graphs of a batch
at once. A token outside the base that skip edges connect, over others or at once,
with a base token takes its likeliest label; if that is a kind, it is a span of its
own, joined with neighbours of its kind. All other tokens stay as they are: the
method adds spans by agreement with a base span of the document only.

Positions are code points, ends exclusive. Defined cases: a null or empty text
has no spans; very long texts and runs take linear time; equal spans of two kinds
are both kept; repeated rows are each searched and returned; an empty table gives
an empty result; only the two named columns are read. The shapes of repeated rows
count as often as they occur.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import column, stored

KINDS = ("email", "ip", "card", "phone")
LABELS = 5            # none, then the kinds
SHAPES = 4096
SMOOTH = 0.5
AGREE = 5.0           # of equal or similar tokens, before anything is counted
HELD = 30.0           # potential that holds a base token to its kind
ROUNDS = 30
DAMPING = 0.3
TOLERANCE = 1e-3
MIN_KEY_DIGITS = 5
MIN_KEY_CHARS = 5
TAIL_DIGITS = 7
CHAIN, SAME, SIMILAR = 0, 1, 2

# Fixed patterns. The look-behinds only skip starts that cannot match, which keeps long runs linear.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
CORE = re.compile(r"[A-Za-z0-9@+](?:.*[A-Za-z0-9])?", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out, last = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def _hash(text: str) -> int:
    return (xxhash.xxh64_intdigest(text) >> 1) or 1


def shape(core: str) -> str:
    """Letters as a, runs of digits by length up to twenty, other marks as they are."""
    out = []
    for part in re.findall(r"[0-9]+|[^\W0-9_]+|[\W_]", core):
        if part[0] in "0123456789":
            out.append(f"d{min(len(part), 20)}")
        else:
            out.append("a" if part[0].isalpha() else part)
    return "".join(out)


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, label, shape bucket, key, similar key, follows the one before) of the tokens with a digit or an @.

    start and end are those of the core: the token without marks around it. A key of 0 means none.
    """
    out, at, before = [], 0, -1
    ordered = sorted((s, e, k) for k, s, e in spans)
    s_at = 0
    while (m := CANDIDATE.search(text, at)) is not None:
        end_match = SPACE.search(text, m.end())
        end = end_match.start() if end_match else len(text)
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        core = CORE.search(text, start, end)
        a, b = core.span() if core else (start, end)
        body = text[a:b]
        label = 0
        while s_at < len(ordered) and ordered[s_at][1] <= start:
            s_at += 1
        i = s_at
        while i < len(ordered) and ordered[i][0] < end:
            if ordered[i][1] > start:
                label = ordered[i][2] + 1
                break
            i += 1
        digits = "".join(c for c in body if c in "0123456789") if not body.isdecimal() or not body.isascii() else body
        key = similar = 0
        if "@" in body:
            key = _hash(body.lower())
            similar = _hash("@" + local) if len(local := body.split("@")[0].lower()) >= MIN_KEY_CHARS else 0
        elif len(digits) >= MIN_KEY_DIGITS:
            key = _hash(body.lower() if any(c.isalpha() for c in body) else digits)
            similar = _hash("#" + digits[-TAIL_DIGITS:]) if len(digits) >= TAIL_DIGITS else 0
        elif len(body) >= MIN_KEY_CHARS:
            key, similar = _hash(body.lower()), _hash("@" + body.lower())
        follows = bool(out) and text[before:start].strip(" \t\n\x0b\x0c\r") == "" if before >= 0 else False
        out.append((a, b, label, xxhash.xxh32_intdigest(shape(body)) % SHAPES, key, similar, follows))
        at = before = end
    return out


READ = pa.schema([
    ("doc_id", pa.int64()), ("spans", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())),
    ("label", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32())), ("key", pa.list_(pa.int64())), ("similar", pa.list_(pa.int64())),
    ("follows", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int64())),
])
READ_SQL = ("doc_id bigint, spans array<bigint>, start array<bigint>, end array<bigint>, label array<int>, bucket array<int>, "
            "key array<bigint>, similar array<bigint>, follows array<boolean>, counts array<bigint>")


LISTS = [f.name for f in READ][2:-1]


def _lists(found: list[list[tuple]]) -> list[pa.Array]:
    """The tokens of each document as one column per part."""
    columns = [[] for _ in LISTS]
    for tokens_ in found:
        for c, values in zip(columns, zip(*tokens_) if tokens_ else [[]] * len(LISTS)):
            c.append(list(values))
    return [pa.array(c, READ.field(n).type) for n, c in zip(LISTS, columns)]


def _read(batches):
    """Spans and tokens of the documents with a base span; the others as counts, in the first row of their piece."""
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            piece = b.slice(i, 1024)
            flat, kept, others = [], [], []
            for text in piece.column(1).to_pylist():
                text = text or ""
                some = CANDIDATE.search(text) is not None
                spans = base_spans(text) if some else []
                found = tokens(text, spans) if some else []
                flat.append([x for s in spans for x in s])
                kept.append(found if spans else [])
                if found and not spans:
                    others.append(found)
            counts = [[] for _ in range(piece.num_rows)]
            if others:
                counted = Counts()
                counted.add(Graph(pa.RecordBatch.from_arrays(_lists(others), LISTS)))
                counts[0] = np.stack(counted.rows(), axis=1).ravel().tolist()
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(flat, READ.field("spans").type), *_lists(kept), pa.array(counts, READ.field("counts").type)], schema=READ)


class Graph:
    """The tokens of a batch of documents as flat arrays, and the edges between them."""

    def __init__(self, b: pa.RecordBatch):
        flat = {n: b.column(b.schema.get_field_index(n)) for n in ("start", "end", "label", "bucket", "key", "similar", "follows")}
        sizes = np.diff(flat["start"].offsets.to_numpy())
        self.doc = np.repeat(np.arange(b.num_rows), sizes)
        for n, column_ in flat.items():
            setattr(self, n, column_.flatten().to_numpy(zero_copy_only=False))
        n = len(self.doc)
        chain = np.flatnonzero(self.follows.astype(bool)) if n else np.empty(0, np.int64)
        edges = [(np.stack([chain - 1, chain], axis=1), CHAIN)]
        same = self._runs(self.key)
        near = self._runs(self.similar)
        if len(same) and len(near):
            near = near[~np.isin(near[:, 0] * n + near[:, 1], same[:, 0] * n + same[:, 1])]
        edges += [(same, SAME), (near, SIMILAR)]
        self.edges = np.concatenate([e for e, _ in edges]) if n else np.empty((0, 2), np.int64)
        self.kind = np.concatenate([np.full(len(e), k) for e, k in edges])

    def _runs(self, key: np.ndarray) -> np.ndarray:
        """Edges from the first token of a document with some key to each other one."""
        at = np.flatnonzero(key != 0)
        order = at[np.lexsort((at, key[at], self.doc[at]))]
        if len(order) < 2:
            return np.empty((0, 2), np.int64)
        new = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (self.doc[order[1:]] != self.doc[order[:-1]])]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return np.stack([first, order], axis=1)[~new]


class Counts:
    """Label pairs by kind of edge (tables 0 to 2), and labels by shape (table 3)."""

    def __init__(self):
        self.pairs = np.zeros((3, LABELS, LABELS), np.int64)
        self.shapes = np.zeros((SHAPES, LABELS), np.int64)

    def add(self, g: Graph):
        np.add.at(self.shapes, (g.bucket.astype(np.int64), g.label.astype(np.int64)), 1)
        if len(g.edges):
            x, y = g.label[g.edges[:, 0]].astype(np.int64), g.label[g.edges[:, 1]].astype(np.int64)
            np.add.at(self.pairs, (g.kind, x, y), 1)
            np.add.at(self.pairs, (g.kind, y, x), 1)  # edges have no direction

    def add_rows(self, t, r, c, n):
        shape_ = t == 3
        np.add.at(self.shapes, (r[shape_], c[shape_]), n[shape_])
        np.add.at(self.pairs, (t[~shape_], r[~shape_], c[~shape_]), n[~shape_])

    def rows(self) -> list[np.ndarray]:
        """Table, row, label and n of what was counted."""
        out = []
        for t, counts in enumerate((*self.pairs, self.shapes)):
            r, c = np.nonzero(counts)
            out.append((np.full(len(r), t), r, c, counts[r, c]))
        return [np.concatenate(x) for x in zip(*out)]


def _count(batches):
    """Partial counts as (table, row, label, n)."""
    counted = Counts()
    for b in batches:
        counted.add(Graph(b))
        done = b.column(b.schema.get_field_index("counts")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counted.add_rows(*done.reshape(-1, 4).T)
    rows = counted.rows()
    if len(rows[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["t", "r", "c", "n"])


def weights(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(potentials of shapes, of label pairs per kind of edge) from the counts over all documents."""
    counts = read.mapInArrow(_count, "t bigint, r bigint, c bigint, n bigint").groupBy("t", "r", "c").agg(F.sum("n").alias("n"))
    pairs, shapes = np.zeros((3, LABELS, LABELS)), np.zeros((SHAPES, LABELS))
    for t, r, c, n in counts.collect():  # at most 3 x 25 + SHAPES x 5 rows
        (shapes if t == 3 else pairs[t])[r, c] = n
    return potentials(shapes, pairs)


def potentials(shapes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node = np.log((shapes + SMOOTH) / (shapes + SMOOTH).sum(axis=1, keepdims=True))
    edge = np.empty_like(pairs)
    for k in range(3):
        p = pairs[k] + SMOOTH + (AGREE * np.eye(LABELS) if k != CHAIN else 0)
        p /= p.sum()
        edge[k] = np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))
    # a document's tokens never agree less for being alike
    for k in (SAME, SIMILAR):
        np.fill_diagonal(edge[k], np.maximum(np.diag(edge[k]), 0.0))
    return node, edge


def beliefs(node: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log beliefs of all nodes by damped loopy message passing. pair: one matrix per edge, symmetric."""
    n, m = len(node), len(edges)
    source = np.r_[edges[:, 0], edges[:, 1]]
    target = np.r_[edges[:, 1], edges[:, 0]]
    both = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    messages = np.zeros((2 * m, LABELS))
    for _ in range(ROUNDS):
        total = node.copy()
        for label in range(LABELS):
            total[:, label] += np.bincount(target, messages[:, label], n)
        send = (total[source] - messages[back])[:, :, None] + both
        top = send.max(axis=1)
        new = top + np.log(np.exp(send - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = DAMPING * messages + (1 - DAMPING) * new
        change = np.abs(new - messages).max(initial=0)
        messages = new
        if change < TOLERANCE:
            break
    total = node.copy()
    for label in range(LABELS):
        total[:, label] += np.bincount(target, messages[:, label], n)
    return total


def linked(n: int, edges: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which nodes the edges connect with a wanted one."""
    root = np.arange(n)
    while True:
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    has = np.zeros(n, bool)
    has[root[wanted]] = True
    return has[root]


def added(g: Graph, node_weights: np.ndarray, edge_weights: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) of the spans that agreement adds."""
    skip = g.edges[g.kind != CHAIN]
    free = linked(len(g.doc), skip, g.label > 0) & (g.label == 0)
    if not free.any():
        return []
    node = node_weights[g.bucket].copy()
    node[:, 1:] = np.where(free[:, None], node[:, 1:], -HELD)  # none, unless free or held
    held = np.flatnonzero(g.label > 0)
    node[held, g.label[held]] = HELD
    b = beliefs(node, g.edges, edge_weights[g.kind])
    label = np.where(free, b.argmax(axis=1), 0)
    out: list[tuple[int, int, int, int]] = []
    last = -2
    for i in np.flatnonzero(label):
        if i == last + 1 and g.follows[i] and label[i] == label[last]:
            d, k, s, _ = out.pop()
            out.append((d, k, s, int(g.end[i])))
        else:
            out.append((int(g.doc[i]), int(label[i]) - 1, int(g.start[i]), int(g.end[i])))
        last = i
    return out


def written(spans) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


OUT_SQL = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, n_added bigint"
OUT_NAMES = [f.split()[0] for f in OUT_SQL.split(", ")]


def _decode(node_weights, edge_weights):
    def run(batches):
        for b in batches:
            more: dict[int, list] = {}
            for d, k, s, e in added(Graph(b), node_weights, edge_weights):
                more.setdefault(d, []).append((k, s, e))
            counts, base, spans = [[0] * b.num_rows for _ in KINDS], [], []
            for i, flat in enumerate(b.column(1).to_pylist()):
                own = list(zip(flat[::3], flat[1::3], flat[2::3]))
                for k, _, _ in own:
                    counts[k][i] += 1
                base.append(written(own))
                spans.append(written(own + more[i]) if i in more else base[-1])
            extra = [len(more.get(i, ())) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())],
                OUT_NAMES)

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per kind of base span, base and spans as text, n_added: one row per row of ``docs``."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    read = stored(d.mapInArrow(_read, READ_SQL), "tokens")
    return read.mapInArrow(_decode(*weights(read)), OUT_SQL)


def masked(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind."""
    out, at = [], 0
    for k, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + text[at:]
