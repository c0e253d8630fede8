"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

No piece of a supported model crosses from a character into a space mark, so a
text falls into marked words that are encoded one by one. The distinct new
words of a slice are sorted and walked depth-first as a trie: the forward
column of a common prefix is computed once and reused by every word below it.

For a unigram model the forward column holds the best score and last piece of
each prefix. For a BPE model it holds the last piece of the prefix's own
encoding: the one piece whose neighbour, the last piece of the rest, stays
beside it when both are merged from characters. That piece is unique, depends
on the prefix alone, and following it back gives exactly the pieces that
merging by rank gives.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locusframe.llm.common import id_text, slices

MARK = "▁"
#: Distinct words, and pairs of pieces, that a worker remembers at most between slices; some 60 MB in all.
REMEMBERED, PAIRS = 200_000, 200_000
#: Characters up to which a string is merged by plain search of the best pair; beyond it by a heap.
SHORT = 14
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """Pieces, scores and kind of a SentencePiece model; plain data, so that it can be broadcast."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        top = dict(_fields(raw))
        trainer, rules = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError("supported: unigram and BPE models with identity normalisation, dummy prefix, marked spaces and all white space kept")
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        plain = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) for i in range(n)]
        if any(MARK in w.lstrip(MARK) for w, ok in zip(names, plain, strict=True) if ok):
            raise ValueError("a piece crosses from a character into a space mark")
        self.ids = {w: i for i, w in enumerate(names) if plain[i]}
        self.scores = {w: p.get_score(i) for w, i in self.ids.items()}
        self.names = names
        self.unk = p.unk_id()
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") if any(p.is_byte(i) for i in range(min(n, 300))) else -1 for b in range(256)]
        self.bytes = self.bytes if min(self.bytes) >= 0 and p.is_byte(self.bytes[0]) else []
        self.surface = [w.replace(MARK, " ").encode() if plain[i] else bytes([int(w[3:5], 16)]) if p.is_byte(i) else " ⁇ ".encode() if p.is_unknown(i) else b"" for i, w in enumerate(names)]
        #: Whether a line feed is never part of a longer piece, so that words can be cut there too.
        self.cut_lines = ("\n" in self.ids or bool(self.bytes)) and not any("\n" in w and len(w) > 1 for w in self.ids)
        if MARK not in self.ids and not self.bytes:
            raise ValueError("the model knows no space mark")  # a run of unknown characters would cross from word to word


class Encoder:
    """Encodes sorted batches of words over one model, sharing forward columns along common prefixes.

    A piece is known by its code: its number in the model, or for a character
    that the model lacks the number of pieces plus its code point.
    """

    def __init__(self, model: PieceModel):
        self.m = model
        self.size = len(model.names)
        self.span = self.size + 0x110001
        #: Last three characters of pieces: the lengths of the pieces that end so, longest first.
        ends: dict[str, set[int]] = {}
        for w in model.ids:
            if len(w) > 2:
                ends.setdefault(w[-3:], set()).add(len(w))
        self.ends = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.tails = self._tails() if model.bpe else {}
        self.stays: dict[int, bool] = {}
        self.floor = min(model.scores.values(), default=0.0) - 10.0

    def _tails(self) -> dict[str, tuple[tuple[int, int], ...]]:
        """Last four characters of pieces, and whole pieces of two and three: length and code of all pieces that a text with this end can end in but single characters, longest first; code -1 for pieces of over four characters."""
        ids, longer = self.m.ids, {}
        for w in ids:
            longer.setdefault(w[-4:], set()).add(len(w))
        out = {}
        for t, lengths in longer.items():
            if len(t) > 1:
                out[t] = (*((n, -1) for n in sorted(lengths, reverse=True) if n > 4), *((n, ids[t[-n:]]) for n in range(min(4, len(t)), 1, -1) if t[-n:] in ids))
        return out

    def merge(self, s: str) -> list[str]:
        """Pieces of s when the adjacent pair of the best score, the leftmost among equals, merges again and again."""
        scores, n = self.m.scores, len(s)
        if n <= SHORT:
            short = list(s)
            while len(short) > 1:
                at, top = -1, 0.0
                for i in range(len(short) - 1):
                    score = scores.get(short[i] + short[i + 1])
                    if score is not None and (at < 0 or score > top):
                        at, top = i, score
                if at < 0:
                    break
                short[at : at + 2] = [short[at] + short[at + 1]]
            return short
        part: list[str | None] = list(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (w := part[i] + part[j]) in scores:
                heapq.heappush(heap, (-scores[w], i, w))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, w = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != w:
                continue
            part[i], part[j] = w, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in part if x is not None]

    def _stay(self, key: int, a: str, b: str) -> bool:
        """Whether the pieces a and b stay beside each other when both are merged from characters; a may be empty."""
        if len(self.stays) >= PAIRS:
            self.stays.clear()
        got = self.stays[key] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Codes of the pieces of each word; words must be sorted, so that each shares with the one before all that any earlier one shares."""
        bpe, ids, scores, size, span = self.m.bpe, self.m.ids, self.m.scores, self.size, self.span
        ends, tails, stays, plain = self.ends, self.tails, self.stays, (2, 1)
        last: list[int] = [0]  # length of the last piece of each prefix
        code: list[int] = [span - 1]  # and its code
        best: list[float] = [0.0]
        before = ""
        for w in words:
            k, top = 0, min(len(w), len(before))
            while k < top and w[k] == before[k]:
                k += 1
            del last[k + 1 :], code[k + 1 :]
            if not bpe:
                del best[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                if bpe:
                    found = tails.get(w[i - 4 : i]) if i > 3 else None
                    if found is None:
                        found = tails.get(w[i - 3 : i]) if i > 2 else None
                        if found is None:
                            found = tails.get(w[i - 2 : i], ()) if i > 1 else ()
                    for n, c in found:
                        j = i - n
                        if c < 0:
                            c = ids.get(w[j:i], -1) if j >= 0 else -1
                            if c < 0:
                                continue
                        key = code[j] * span + c
                        ok = stays.get(key)
                        if ok is None:
                            ok = self._stay(key, w[j - last[j] : j], w[j:i])
                        if ok:
                            last.append(n)
                            code.append(c)
                            break
                    else:
                        t = w[i - 1]
                        c = ids.get(t, -1)
                        if c < 0:
                            c = size + ord(t)
                        key = code[i - 1] * span + c
                        ok = stays.get(key)
                        if ok is None:
                            ok = self._stay(key, w[i - 1 - last[i - 1] : i - 1], t)
                        if not ok:
                            raise AssertionError(f"no encoding of {w[:i]!r}")
                        last.append(1)
                        code.append(c)
                else:
                    lengths = ends.get(w[i - 3 : i], plain) if i > 2 else plain
                    t = w[i - 1]
                    top_n, top_s = 1, best[i - 1] + scores.get(t, self.floor)
                    for n in reversed(lengths):
                        s = scores.get(w[i - n : i]) if 1 < n <= i else None
                        if s is not None and best[i - n] + s > top_s:
                            top_n, top_s = n, best[i - n] + s
                    last.append(top_n)
                    best.append(top_s)
                    code.append(ids.get(w[i - top_n : i], size + ord(t)))
            out, i = [], len(w)
            while i:
                out.append(code[i])
                i -= last[i]
            out.reverse()
            before = w
            yield out

    def numbers(self, codes: list[int]) -> list[int]:
        """Token ids of codes: the bytes of characters that the model lacks, or one unknown for each run of them."""
        m, size = self.m, self.size
        if not codes or max(codes) < size:
            return codes
        out, unknown = [], False
        for c in codes:
            if c < size:
                out.append(c)
            elif m.bytes:
                out.extend(m.bytes[b] for b in chr(c - size).encode("utf-8", "surrogatepass"))
            elif not unknown:
                out.append(m.unk)
            unknown = c >= size
        return out

    def codes(self, pieces: list[str]) -> list[int]:
        return [self.m.ids.get(t, self.size + ord(t[0])) for t in pieces]


def words_of(text: str, cut_lines: bool = True) -> list[str]:
    """Keys of the marked words of a text. A key's first word mark is implied; each blank before it is a further mark; a line feed before it means that it has no mark of its own."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    parts = (text.replace("\n", " \n") if cut_lines else text).split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if not p:
            run += 1
        elif run and p[0] == "\n" and cut_lines:
            out += [" " * run, p]
            run = 0
        else:
            out.append(" " * run + p)
            run = 0
    return out + [" " * run] * bool(run)


class Lexicon:
    """Words met so far by a worker, their token ids in one flat array; at most `most` stay from slice to slice, those of several slices first."""

    def __init__(self, model: PieceModel, most: int = REMEMBERED):
        self.encoder, self.model, self.most = Encoder(model), model, most
        self.slot: dict[str, int] = {}
        self.flat, self.start, self.length = array("i"), array("q"), array("i")
        self.seen = np.zeros(0, np.uint8)  # slices that held each word, halved whenever words are forgotten
        self.runs: dict[int, list[int]] = {}

    def _add(self, keys: Iterable[str], ids: Iterable[list[int]]) -> None:
        """Takes words and their ids in; ids come one by one, so that the lists of many words never stand side by side."""
        flat, start, length, at = self.flat, self.start, self.length, len(self.flat)
        for x in ids:
            flat.extend(x)
            start.append(at)
            length.append(len(x))
            at += len(x)
        self.slot.update(zip(keys, range(len(self.slot), len(start)), strict=True))

    def _forget(self) -> None:
        """Keeps the words that several slices held, at most half of those that may stay: those of the most slices."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(self.seen[keep], kind="stable")[len(keep) - self.most // 2 :]])
        start, length, flat = (np.frombuffer(x, d) for x, d in ((self.start, np.int64), (self.length, np.int32), (self.flat, np.int32)))
        lens = length[keep].astype(np.int64)
        first = np.cumsum(lens) - lens
        ids = flat[np.repeat(start[keep] - first, lens) + np.arange(int(lens.sum()))]
        words = list(self.slot)
        self.slot = {words[i]: at for at, i in enumerate(keep.tolist())}
        self.flat, self.start, self.length = array("i", ids.tobytes()), array("q", first.tobytes()), array("i", length[keep].tobytes())
        self.seen = self.seen[keep] // 2

    def learn(self, keys: set[str]) -> None:
        if len(self.slot) > self.most:
            self._forget()
        m, e = self.model, self.encoder
        new = sorted(keys.difference(self.slot))
        plain = [k for k in new if k[:1] not in (" ", "\n", "")]
        self._add(plain, map(e.numbers, e.walk([MARK + k for k in plain])))
        tasks: dict[str, list[str]] = {}  # word: the keys with blanks or a line feed before it
        ids: dict[str, list[int]] = {}
        for key in new:
            if key[:1] not in (" ", "\n", ""):
                continue
            body = key.lstrip(" ")
            if not body:
                ids[key] = e.numbers(self._run(len(key)))
            elif m.cut_lines and key[0] == "\n":
                tasks.setdefault(body[1:], []).append(key)
            else:  # in a unigram model the marks before a word may be shared out in any way
                tasks.setdefault(MARK * (1 if m.bpe else len(key) - len(body) + 1) + body, []).append(key)
        todo = sorted(tasks)
        for word, codes in zip(todo, e.walk(todo), strict=True):
            for key in tasks[word]:
                if m.cut_lines and key[0] == "\n":
                    ids[key] = e.numbers([*e.codes(["\n"]), *codes])
                    continue
                extra = len(key) - len(word) + 1
                if m.bpe and extra and codes[0] == m.ids.get(MARK):  # the word's own mark joins the run before it
                    ids[key] = e.numbers(self._run(extra + 1) + codes[1:])
                else:
                    ids[key] = e.numbers((self._run(extra) if m.bpe and extra else []) + codes)
        self._add(list(ids), list(ids.values()))

    def _run(self, n: int) -> list[int]:
        """Codes of n marks; short runs are remembered."""
        got = self.runs.get(n)
        if got is None:
            e = self.encoder
            got = e.codes(e.merge(MARK * n)) if self.model.bpe else next(e.walk([MARK * n]))
            if n < 256:
                self.runs[n] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts behind one another, and the offsets of each text."""
        parts = [words_of(t, self.model.cut_lines) for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        del parts
        self.seen = np.r_[self.seen, np.zeros(len(self.start) - len(self.seen), np.uint8)]
        held = np.flatnonzero(np.bincount(at, minlength=len(self.seen)))
        self.seen[held] += self.seen[held] < 255
        start, length, flat = (np.frombuffer(x, d) for x, d in ((self.start, np.int64), (self.length, np.int32), (self.flat, np.int32))) if len(self.start) else (np.zeros(1, np.int64),) * 3
        lens = length[at].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[at] - (ends - lens), lens) + np.arange(total)].astype(np.int32) if total else np.zeros(0, np.int32)
        edge = np.r_[0, np.cumsum(counts)]
        return ids, np.r_[0, ends][edge]


def decode(surface: list[bytes], ids: list[int]) -> str:
    """Text of a list of token ids, without the dummy prefix."""
    raw = b"".join([surface[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_LEXICONS: dict[int, Lexicon] = {}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("exact", pa.bool_())])
_SQL = "doc_id long, n_tokens long, token_ids array<int>, exact boolean"


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_tokens, token_ids, and exact: whether decoding gives the text back.

    Null and empty texts have no tokens and are exact; repeated rows, and rows
    with a null identifier, are encoded each; an empty table gives no rows;
    other columns stay outside. A literal space mark in a
    text is read as a space, as the model does, so such a text is not exact. The
    model's pieces (its size is fixed) are broadcast; executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[id(model)] = Lexicon(model)
        lexicon = _LEXICONS[id(model)]
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, offsets = lexicon.encode(texts)
                listed = ids.tolist()
                exact = [decode(model.surface, listed[a:b]) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), tokens, pa.array(exact, pa.bool_())], schema=_SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(run, _SQL)


def decode_documents(tokens: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids; a null list gives a null text, unknown ids nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(PieceModel(model_path).surface)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = shared.value
        for batch in batches:
            texts = [None if x is None else decode(surface, [i for i in x if i is not None and 0 <= i < len(surface)]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), tokens["token_ids"].cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
