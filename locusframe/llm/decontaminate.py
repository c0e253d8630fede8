"""Benchmark decontamination with a generalised suffix automaton.

All benchmark items go into one automaton over word numbers. A document is
streamed through it once; wherever the longest suffix that occurs in some item
reaches a window's length, the window's words are hit. Runs of words that
cannot hold a window (a word or a pair of neighbours that no item has) are
stepped over with numpy before the automaton is entered; that loses nothing.

The items are shipped to the executors in blocks of at most BLOCK_WORDS words.
A benchmark of more than one block is passed block by block over all documents
and the hits are united, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import cut, id_text, raw_texts, slices

WINDOW = 13
#: Words of benchmark items in one automaton at most; a longer item is cut into parts that overlap by a window less one word.
BLOCK_WORDS = 200_000

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased words of letters, digits and non-ASCII characters."""
    return raw.translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, with the items of each window-length class."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.full: dict[int, list[str]] = {}
        self.short: dict[int, dict[int, list[str]]] = {}  # names by length, the longest first
        for name, seq in items:
            if len(seq) < window:
                if seq:
                    state = 0
                    for w in seq:
                        state = self.next[state][w]
                    self.short.setdefault(state, {}).setdefault(len(seq), []).append(name)
                continue
            state = n = 0
            seen = set()
            for w in seq:
                state, n = self.next[state][w], n + 1
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                    n = self.length[state]
                if n >= window and state not in seen:
                    seen.add(state)
                    self.full.setdefault(state, []).append(name)
        self.short = {u: dict(sorted(by.items(), reverse=True)) for u, by in self.short.items()}
        self._mark()

    def _mark(self) -> None:
        """For each state, the state of its suffix of window length (0: too short) and the nearest one, itself included, that ends a short item (0: none)."""
        n, link, length = len(self.link), self.link, self.length
        self.at, self.near = [0] * n, [0] * n
        for u in sorted(range(1, n), key=length.__getitem__):  # a suffix link leads to a shorter state
            self.at[u] = 0 if length[u] < self.window else u if length[link[u]] < self.window else self.at[link[u]]
            self.near[u] = u if u in self.short else self.near[link[u]]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, seq: list[int], offset: int, hits: list[tuple[int, int]], found: set[str]) -> None:
        """Adds to hits (start, end) word spans that cover all windows that occur in seq, and their items to found; a state's items are added once, however often it is met."""
        state = n = 0
        nxt, link, length, window, at, near = self.next, self.link, self.length, self.window, self.at, self.near
        met: set[tuple[int, int]] = set()
        for i, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            longest = 0
            if n >= window and (names := self.full.get(at[state])):
                longest = window
                if (at[state], window) not in met:
                    met.add((at[state], window))
                    found.update(names)
            u = near[state]
            while u:  # at most one state for each length under the window
                for k, names in self.short[u].items():
                    if k <= n:
                        longest = max(longest, k)
                        if (u, k) not in met:
                            met.add((u, k))
                            found.update(names)
                u = near[link[u]]
            if longest:  # shorter windows that end here lie within
                hits.append((offset + i + 1 - longest, offset + i + 1))


class Matcher:
    """Automaton of one block of items, with the vocabulary and pair tables that let documents skip ahead."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        split = [(name, words(raw)) for name, raw in items]
        self.vocabulary: dict[bytes, int] = {}
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in split]
        coded = [x for x in coded if x[1]]
        self.automaton = SuffixAutomaton(coded, window)
        self.least = min([window, *(len(seq) for _, seq in coded)])
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for _, seq in coded for a, b in zip(seq, seq[1:], strict=False)], np.int64))

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocabulary or len(ws) < self.least:
            return hits, found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        inside = ids >= 0
        # a link joins word i to i + 1 if some item has both side by side
        linked = inside[:-1] & inside[1:]
        if linked.any() and len(self.pairs):
            at = np.flatnonzero(linked)
            code = ids[at] * len(self.vocabulary) + ids[at + 1]
            linked[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
        edges = np.flatnonzero(~linked) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(ws)]
        for k in np.flatnonzero((ends - starts >= self.least) & inside[starts]):
            self.automaton.scan(ids[starts[k] : ends[k]].tolist(), int(starts[k]), hits, found)
        return hits, found


def united(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut_item(raw: bytes, most: int, window: int) -> list[bytes]:
    """The item, or if it has over `most` words, parts of `most` words whose windows are together those of the item."""
    ws = words(raw)
    most = max(most, window)
    if len(ws) <= most:
        return [raw]
    return [b" ".join(ws[i : i + most]) for i in range(0, len(ws) - window + 1, most - window + 1)]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """Items (distinct identifiers and texts) in blocks, streamed to the driver one partition at a time; longer items are cut into overlapping parts."""
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("i"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("t")).distinct()
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        for raw in _cut_item(r["t"].encode(), block_words, window):
            n = len(words(raw))
            if block and size + n > block_words:
                yield block
                block, size = [], 0
            block.append((r["i"], raw))
            size += n
    yield block


def _by_name(name: str | None) -> tuple[bool, str]:
    """Order of identifiers, null last."""
    return name is None, name or ""


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_FOUND = "n_words long, hits array<struct<s:int,e:int>>, items array<string>"


def _scanner(shared, window: int, only_hits: bool):
    """Adds the columns of _FOUND behind those of a batch, whose second is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, window)  # goes with the partition: workers serve other stages too
        for batch in batches:
            for part in slices(batch):
                n, hits, items = [], [], []
                for raw in raw_texts(part):
                    ws = words(raw)
                    spans, found = matcher.spans(ws)
                    n.append(len(ws))
                    hits.append([{"s": s, "e": e} for s, e in united(spans)])
                    items.append(sorted(found, key=_by_name))
                more = [pa.array(n, pa.int64()), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string()))]
                keep = pa.array([bool(x) or not only_hits for x in items], pa.bool_())
                own = [c for i, c in enumerate(part.columns) if i != 1 or not only_hits]
                names = [x for i, x in enumerate(part.schema.names) if i != 1 or not only_hits]
                out = pa.RecordBatch.from_arrays([*own, *more], names=[*names, "n_words", "hits", "items"])
                yield out.filter(keep) if only_hits else out

    return run


def _united(found: DataFrame) -> DataFrame:
    """doc_id, k, hits (sorted, those that overlap or touch made one) and items of rows with doc_id, k, hits and items."""
    spans = found.select("doc_id", "k", F.inline("hits"))
    own = Window.partitionBy("doc_id", "k").orderBy("s", "e")
    before = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    one = spans.groupBy("doc_id", "k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    hits = one.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("hits"))
    items = found.groupBy("doc_id", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return hits.alias("x").join(items.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.k") == F.col("y.k"))).select("x.doc_id", "x.k", "hits", "items")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_words, hits (disjoint word spans), items (sorted identifiers) of each document row; text and row (a struct of all columns but the text) too if whole_rows.

    Null and empty texts have no words. Items without words never occur; rows
    that repeat an item count once. Items with a null identifier hit like any
    other and stand as one null at the end of items. An empty
    benchmark hits nothing and an empty document table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[rest.alias("row")] * whole_rows)
    own = "doc_id long, text string" + (f", row {d.schema['row'].dataType.simpleString()}" if whole_rows else "")
    key_of_row = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    shared = [sc.broadcast(block) for block in blocks(benchmark, block_words, window)]
    names = ["doc_id", *["text", "row"] * whole_rows]
    if len(shared) == 1:
        return d.mapInArrow(_scanner(shared[0], window, False), f"{own}, {_FOUND}").select(*names, "n_words", "hits", "items")
    base = d.mapInArrow(_scanner(sc.broadcast([]), window, False), f"{own}, {_FOUND}")  # counts words only
    keyed = d.select("doc_id", "text", key_of_row.alias("k"))
    parts = [keyed.mapInArrow(_scanner(x, window, True), f"doc_id long, k binary, {_FOUND}").select("doc_id", "k", "hits", "items") for x in shared]
    # Rows with the same identifier and text have the same hits, so these two make a key.
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    a, b = base.withColumn("k", key_of_row).alias("a"), _united(cut(found.distinct())).alias("b")
    none = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<string>")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.k") == F.col("b.k")), "left").select(
        *[f"a.{x}" for x in names], "a.n_words", F.coalesce("b.hits", none[0]).alias("hits"), F.coalesce("b.items", none[1]).alias("items")
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    return find(docs, benchmark, window, block_words).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return raw
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(raw)]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]])


def _cleaner(shared, window: int, max_coverage: float):
    """(row, text) rows of (row, text) rows: the texts without the spans that one block of items hits, rows over max_coverage left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, window)
        for batch in batches:
            for part in slices(batch):
                stays, changed = [True] * part.num_rows, {}
                for i, raw in enumerate(raw_texts(part)):
                    ws = words(raw)
                    spans = united(matcher.spans(ws)[0])
                    if spans:
                        stays[i] = sum(e - s for s, e in spans) <= max_coverage * len(ws)
                        changed[i] = cut_spans(raw, spans)
                texts = part.column(1)
                if changed:
                    old = texts.cast(pa.binary()).to_pylist()
                    texts = pa.array([changed.get(i, x) for i, x in enumerate(old)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["row", "text"]).filter(pa.array(stays, pa.bool_()))

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs with hit spans cut out of their texts; a row with over max_coverage of its words hit goes.

    Rows without hits are unchanged, null texts included; repeated rows are
    treated each alike. An empty benchmark changes nothing, an empty table gives
    no rows. All columns pass.
    """
    names = [c for c in docs.columns if c != "text"]
    back = lambda out: out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    d = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].cast("string").alias("text"))
    kind = f"row {d.schema['row'].dataType.simpleString()}, text string"
    parts = list(blocks(benchmark, block_words, window))
    if len(parts) == 1:
        return back(d.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(parts[0]), window, max_coverage), kind))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, spans = part.column(1), part.column(2).to_pylist()
                if any(spans):
                    raws = texts.cast(pa.binary()).to_pylist()
                    texts = pa.array([cut_spans(r, [(x["s"], x["e"]) for x in spans_of]) if spans_of else r for r, spans_of in zip(raws, spans, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["row", "text"])

    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    found = find(docs, benchmark, window, block_words, whole_rows=True).where(n_hit <= max_coverage * F.col("n_words"))
    return back(found.select("row", "text", "hits").mapInArrow(strip, kind))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iv AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iv),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, i, k, item FROM dg JOIN iv USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
