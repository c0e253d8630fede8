import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import components, jaccard, line_dedup, pieces, quality, toxicity
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


def brute_components(docs, words, percent):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def edited(rnd, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = f"e{rnd.randrange(10**6)}"
    return ws


def near_copies(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(1000 + i, t) for i, (_, t) in enumerate(ROWS[:9])]
    common = [rnd.choice(vocab) for _ in range(25)]
    for g in range(9):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 60, 200]))]
        for k in range(rnd.choice([1, 2, 6, 25])):
            ws = edited(rnd, base, rnd.randrange(0, 1 + len(base) // 40)) if k else base
            docs.append((g * 100 + k, " ".join(ws + (common if g % 3 == 0 else []))))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "bucket", "heavy", "words", "percent"), [(1, 4096, 50_000, 4, 85), (2, 4, 5, 4, 85), (3, 3, 50, 5, 80)])
def test_jaccard_brute(spark, docs_of, seed, bucket, heavy, words, percent):
    docs = near_copies(seed)
    got = jaccard.jaccard_components(docs_of(docs), words=words, percent=percent, bucket=bucket, heavy=heavy)
    assert sorted(map(tuple, got.collect())) == brute_components(docs, words, percent)


def test_jaccard_odd(spark, odd):
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(2, 0)] == 2 and by[(6, 1)] == 5 and by[(None, 1)] is None and by[(None, 0)] is None
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 26])
def test_jaccard_nulls_link_and_rows_repeat(spark, docs_of, bucket_bytes):
    base = [f"w{i}" for i in range(60)]
    text = lambda *edits: " ".join(f"e{i}" if i in edits else w for i, w in enumerate(base))
    # 1 and 3 link only through the row without an identifier
    docs = [(1, text(0, 1)), (None, text(1)), (3, text(1, 59, 58)), (3, "quite another text under the same number"), (3, "quite another text under the same number"), (4, "apart")]
    assert not 185 * 51 >= 85 * 114  # 51 of 57 shingles are shared by 1 and 3
    got = jaccard.jaccard_components(docs_of(docs), percent=92, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 57, 1), (1, 57, 1), (3, 4, 3), (3, 4, 3), (3, 57, 1), (4, 1, 4)]


@pytest.mark.parametrize("bucket", [4096, 8])
def test_jaccard_ships_near_copies_once(spark, docs_of, monkeypatch, bucket):
    base = [f"w{i}" for i in range(200)]
    # a pair that meets in many buckets, as every four words of it are a text of their own; most of the nodes in its buckets link with none
    docs = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), *((10 + i, " ".join(base[i : i + 4])) for i in range(196))]
    shipped, search = [], jaccard._search

    def seen(docs, names, targets, percent, words):
        shipped.extend(r.node for r in targets.select("node").collect())
        return search(docs, names, targets, percent, words)

    monkeypatch.setattr(jaccard, "_search", seen)
    got = jaccard.jaccard_components(docs_of(docs), bucket=bucket)
    assert sorted(map(tuple, got.collect())) == brute_components(docs, 4, 85)
    pair = [jaccard.node_of(jaccard.shingles(t.encode(), jaccard.Hashes())) for _, t in docs[:2]]
    assert [shipped.count(x) for x in pair] == [1, 1] and len(shipped) < 60  # sketches of one shingle may be alike


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_sifted_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "SIEVE_BITS", bits)
    rows = spark.range(4000).selectExpr("id % 2 = 0 AS nil", "id * 7919 - 9000000 AS at")
    got = [tuple(r) for r in jaccard._sifted(rows, rows.where("at % 100 = 0"), "nil", "at").collect()]
    assert len(got) == len(set(got)) and {a for _, a in got if a % 100 == 0} == {i * 7919 - 9000000 for i in range(4000) if i * 7919 % 100 == 0}
    assert len(got) < 400 or bits == 64
    assert jaccard._sifted(rows, rows.limit(0), "nil", "at").count() == 0


def brute_keep_one(docs, words, percent):
    """(doc_id, text) of the rows that stay, by holding every row against every other."""
    comps = brute_components([(i, t) for i, (_, t) in enumerate(docs)], words, percent)
    groups, out = {}, []
    for i, n, c in comps:
        groups.setdefault(c, []).append(docs[i]) if n else out.append(docs[i])
    return sorted(out + [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()], key=repr)


def test_keep_one_by_row(spark, docs_of):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = [(1, a), (5, a), (5, b), (7, "x y"), (7, "x y"), (None, b), (None, "lone words"), (8, None), (8, None), (9, ""), (10, " \n")]
    got = sorted((tuple(r) for r in jaccard.keep_one(docs_of(docs)).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, "x y"), (None, "lone words"), (8, None), (8, None), (9, ""), (10, " \n")], key=repr) == brute_keep_one(docs, 4, 85)
    rnd = [(i % 50 if i % 7 else None, t) for i, (_, t) in enumerate(near_copies(5))]
    got = jaccard.keep_one(docs_of(rnd), words=5, percent=80).collect()
    ids = lambda rows: sorted(str(i) for i, _ in rows)  # noqa: E731  of several texts under the smallest identifier any may stay
    assert ids(map(tuple, got)) == ids(brute_keep_one(rnd, 5, 80))


def test_keep_one_odd(spark, odd):
    out = jaccard.keep_one(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in {(i, t) for i, t in ROWS if i != 6})
    assert jaccard.keep_one(odd.limit(0)).count() == 0


def test_bucket_search_brute():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        base = np.unique(rnd.integers(0, 2**63, 120).astype(np.uint64))
        sets = [np.unique(np.r_[rnd.choice(base, len(base) - k, replace=False), rnd.integers(0, 2**63, k).astype(np.uint64)]) for k in rnd.integers(0, 15, 20)]
        q = int(rnd.integers(20))
        want = [j for j in range(20) if j != q and 185 * len(np.intersect1d(sets[q], sets[j])) >= 85 * (len(sets[q]) + len(sets[j]))]
        assert jaccard.Bucket(sets).search(q) == want
        keep = jaccard.may_link(np.array([len(s) for s in sets]), [jaccard.sketch(s).tobytes() for s in sets])
        assert not want or keep[q] and keep[want].all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert all(got[a] == got[b] for a, b in edges if a is not None and a != b) and all(v <= k for k, v in got.items())


def brute_lines(docs, least=line_dedup.MIN_WORDS, bound=1):
    """Texts after line dedup, by holding every line against every earlier one."""

    def one_away(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if len(a) < len(b):
            a, b = b, a
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    earlier, out = [], {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        keep = []
        for line in (t or "").split("\n"):
            w = line.split()
            gone = bool(w) and any(w == e or (bound and min(len(w), len(e)) >= least and one_away(w, e)) for e in earlier)
            if w:
                earlier.append(w)
            if not gone:
                keep.append(line)
        out[d] = None if t is None else "\n".join(keep)
    return out


@pytest.mark.parametrize(("seed", "least", "bound"), [(1, 5, 1), (2, 5, 1), (3, 1, 1), (4, 2, 1), (5, 3, 1), (6, 9, 1), (7, 5, 0)])
def test_line_dedup_brute(spark, docs_of, seed, least, bound):
    rnd = random.Random(seed)
    lines = []
    for n in [*range(1, 21), 40, 300]:
        base = [rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(n)]
        lines.append(base)
        for _ in range(8):
            ws, i = list(base), rnd.randrange(n)
            how = rnd.randrange(4)
            ws[i : i + (how != 1)] = [] if how == 0 and n > 1 else ["new" + str(rnd.randrange(2))]
            if how == 3:
                ws[rnd.randrange(len(ws))] = "more"
            lines.append(ws)
        lines.append(["same"] * n)
    docs = []
    for d in range(60):
        body = [("  " if rnd.random() < 0.2 else " ").join(rnd.choice(lines)) for _ in range(rnd.randrange(6))]
        docs.append((d, "\n".join(x + rnd.choice(["", " ", "\t"]) for x in body + [""] * rnd.randrange(2))))
    docs += [(50, None), (51, ""), (52, "\n\n")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(docs), least=least, bound=bound).collect()}
    assert got == brute_lines(docs, least, bound)
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs_of(docs), least=0)


def test_lines_are_split_once(spark, docs_of):
    above = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # noqa: E731  a step behind the spreading of rows runs for each of them
    texts = spark.createDataFrame([(1, 2, 3, 0, 15, "a b c d e f g")], "h1 long, h2 long, doc_id long, line_no int, held int, norm string")
    assert "split(" not in above(line_dedup._keyed(texts))
    assert "split(" not in above(line_dedup._texts(docs_of([(3, "a b\nc d")]), texts.drop("norm"), "doc_id", "text"))


def test_line_dedup_odd(spark, odd):
    rows = line_dedup.line_dedup(odd)
    assert rows.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = rows.collect()
    assert len(got) == len(ROWS)
    assert [r.text for r in got if r.doc_id == 5] == ["same text twice"] * 2 and [r.text for r in got if r.doc_id == 6] == [""]
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


TEXTS = ["", "Hello  world\n\ttest\x00 ▁x é 你 \U0001f600", " ", "  a ", "a" * 5000, " " * 100 + "x", "x" + " " * 37, "\n", "\n\nab\n", "a\n b \n\n  c", "\r\nA é ﬁ", "word " * 3000, "1234567890 3.14159 https://x.y/z?q=1", "🎉🎉 ü﻿　"]


def test_pieces_match_library(spark, docs_of):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rnd = random.Random(8)
    texts = TEXTS + ["".join(rnd.choice("ab the\n  éß你▁.") for _ in range(80)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = pieces.encode_documents(docs_of(list(enumerate(texts)) + [(-1, None)])).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert r.token_ids == p.encode(t), repr(t[:100])
        assert r.n_tokens == len(r.token_ids) and r.exact == ("▁" not in t)
    back = {r.doc_id: r.text for r in pieces.decode_documents(spark.createDataFrame(got)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def field(k, value):
    return varint(k << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces_of, byte_pieces):
    """A unigram SentencePiece model with identity normalisation, written field by field (1 piece, 2 trainer, 3 rules)."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_pieces] + [(w, s, 1) for w, s in pieces_of.items()]
    raw = b"".join(field(1, field(1, w.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(kind)) for w, s, kind in rows)
    raw += field(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(int(byte_pieces)))
    raw += field(3, field(1, b"identity") + b"".join(varint(k << 3) + varint(v) for k, v in ((3, 1), (4, 0), (5, 1))))
    path.write_bytes(raw)


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_unigram_end_to_end(spark, docs_of, tmp_path, byte_pieces):
    import sentencepiece

    rnd = random.Random(5)
    plain = {"▁": -3.0} | {c: -4.0 - i / 100 for i, c in enumerate("abcd\n")}
    plain |= {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 6))): -rnd.uniform(2, 9) for _ in range(60)}
    plain |= {"▁" + "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 4))): -rnd.uniform(2, 9) for _ in range(20)} | {"▁▁": -4.5, "▁▁▁▁": -6.1}
    model_file(tmp_path / "u.model", plain, byte_pieces)
    p = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["".join(rnd.choice("aabbccdd  \nxé") for _ in range(rnd.randrange(60))) for _ in range(400)] + ["", " ", "abcd" * 2000]
    got = pieces.encode_documents(docs_of(list(enumerate(texts))), model_path=str(tmp_path / "u.model")).collect()
    scores = {p.piece_to_id(w): s for w, s in plain.items()}
    worth = lambda ids: round(sum(scores.get(i, 0.0) for i in ids), 3)
    for r in got:
        want = p.encode(texts[r.doc_id])
        # of two best paths with equal scores either will do
        assert r.token_ids == want or (worth(r.token_ids) == worth(want) and p.decode(r.token_ids) == p.decode(want)), repr(texts[r.doc_id])
        assert r.exact == (byte_pieces or not set(texts[r.doc_id]) & set("xé"))


def test_unigram_walk_brute():
    class Model:
        bpe, bytes, unk = False, [], 0
        scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -3.2, "c": -2.0, "bc": -1.2}
        names = ["<unk>", *scores]
        ids = {w: i + 1 for i, w in enumerate(scores)}

    def best(w):
        if not w:
            return 0.0
        return max(best(w[:-n]) + (Model.scores.get(w[-n:], -13.2 if n == 1 else -1e9)) for n in range(1, min(3, len(w)) + 1))

    e = pieces.Encoder(Model)
    words = sorted({"".join(random.Random(i).choice("abcx") for _ in range(1 + i % 7)) for i in range(200)})
    for w, got in zip(words, e.walk(words)):
        text = [Model.names[c] if c < e.size else chr(c - e.size) for c in got]
        assert "".join(text) == w and abs(sum(Model.scores.get(t, e.floor) for t in text) - best(w)) < 1e-9


def test_lexicon_forgets(spark):
    import sentencepiece

    p, lexicon = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.Lexicon(pieces.PieceModel(pieces.DEFAULT_MODEL), most=20)
    rnd = random.Random(3)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["often", "the", "of", f"w{rnd.randrange(99)}é"]) for _ in range(9)) for _ in range(4)]
        ids, at = lexicon.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == p.encode(texts)
    assert len(lexicon.slot) <= 60 and "often" in lexicon.slot


def test_lexicon_keeps_the_commonest():
    lexicon = pieces.Lexicon(pieces.PieceModel(pieces.DEFAULT_MODEL), most=20)
    common, often = [f"common{i}" for i in range(8)], [f"often{i}" for i in range(8)]
    for i in range(6):
        lexicon.encode([" ".join(common + often * (i < 2))])
    want = lexicon.encode([" ".join(common)])[0].tolist()
    lexicon._forget()  # 16 words of several slices, 10 of which may stay
    assert len(lexicon.slot) == 10 and set(common) <= set(lexicon.slot)
    assert lexicon.encode([" ".join(common)])[0].tolist() == want and len(lexicon.slot) == len(lexicon.start) == 10


def test_merge_by_search_as_by_heap(monkeypatch):
    e, rnd = pieces.Encoder(pieces.PieceModel(pieces.DEFAULT_MODEL)), random.Random(4)
    words = ["".join(rnd.choices(list(e.m.ids), k=3))[: pieces.SHORT] for _ in range(500)] + ["a" * 14, "é你x", "", "x"]
    short = [e.merge(w) for w in words]
    monkeypatch.setattr(pieces, "SHORT", -1)
    assert short == [e.merge(w) for w in words]


def test_pieces_odd(spark, odd):
    assert pieces.encode_documents(odd).count() == len(ROWS) and pieces.encode_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.8), (toxicity, "toxic", 0.9)])
def test_classifier_held_out(spark, odd, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    got = module.score(docs, model).where("held_out").join(labels, "doc_id").select("score", label).toPandas()
    pos, neg = got[got[label] == 1].score.to_numpy(), got[got[label] == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert auc >= least
    out = module.score(odd, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert module.score(odd.limit(0), model).count() == 0
    alone = module.train(docs, labels.where(F.lit(False)))
    assert module.score(odd, alone).count() == len(ROWS)


def test_trees_against_plain_walk():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.grow(x, y, trees=20, depth=3)
    assert ((t.score(x) > 0.5) == y).mean() > 0.9
    for row in x[:30]:
        total = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[t.feature[k, node]] > t.threshold[k, node])
            total += t.leaf[k, node - 7]
        assert abs(total - t.margin(row[None])[0]) < 1e-9


def test_counterfactual_penalty(spark, docs_of):
    rnd = random.Random(6)
    filler = [f"fill{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        ws = [rnd.choice(filler) for _ in range(12)]
        # "muslim" is unevenly spread over the labels, "vile" is what makes a text toxic
        ws += ["vile"] * toxic + (["muslim"] if rnd.random() < (0.7 if toxic else 0.05) else ["christian"] if rnd.random() < 0.3 else [])
        rnd.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(rows)
    probe = docs_of([(1, "fill1 muslim fill2"), (2, "fill1 christian fill2"), (3, "vile fill2")])
    fair = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.train(docs, labels)).collect()}
    assert abs(fair[1] - fair[2]) < 0.1 and fair[1] < 0.5 and fair[3] > 0.7


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = None
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        before = {r.doc_id: r.text for r in docs.collect()}
        if i < 4:
            assert tuple(out.columns) == cp.COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            kept = out.collect()
            assert all(r.n_chars == len(r.text or "") for r in kept) and {r.doc_id for r in kept} <= set(before)
            if i == 1:
                want = brute_lines([(d, t) for d, t in before.items()])
                assert {r.doc_id: r.text for r in kept} == {d: t for d, t in want.items() if not before[d] or t.strip() or not before[d].strip()}
            if i == 2:
                comps = brute_components(sorted(before.items()), 5, 80)
                assert {r.doc_id for r in kept} == {c for _, _, c in comps}
            docs = spark.createDataFrame([tuple(r) for r in kept], docs.schema)
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept}
    assert cp.run(spark, sf).count() == len(kept)


def test_pipeline_stages_brute(spark):
    """The stages with a model, a scan and an encoding, each held against a plain version over its own input."""
    import sentencepiece

    import corpus_pipeline as cp
    from tests.llm.test_simple_ops import brute_windows

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    large = "/root/testdata/sf0.01"  # enough labels to learn from
    more = spark.read.parquet(f"{large}/documents.parquet")
    model = toxicity.train(more, spark.read.parquet(f"{large}/labels.parquet"))
    all_ = {r.doc_id: r.text for r in more.collect()}

    def score(text):
        held = {f for w in toxicity.words(text or "") for f in toxicity.features(w) if f in model.weight}
        return 1 / (1 + np.exp(-(model.bias + sum(model.weight[f] for f in held))))

    kept = {r.doc_id for r in cp.drop_toxic(spark, more, large).collect()}
    assert kept == {i for i, t in all_.items() if t is None or score(t) < toxicity.CUT} and 0 < len(kept) < len(all_)

    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    cleaned = {r.doc_id: r.text for r in cp.cut_benchmark(spark, docs, sf).collect()}
    hit = {i: (n, h) for i, n, h, *_ in brute_windows(list(texts.items()), bench)}
    assert set(cleaned) == {i for i, (n, h) in hit.items() if h <= 0.5 * n}
    assert all((cleaned[i] == texts[i]) == (hit[i][1] == 0) for i in cleaned)
    rest = brute_windows([(i, cleaned[i]) for i in cleaned if hit[i][1]], [(0, "never occurs")])
    assert all(n == hit[i][0] - hit[i][1] for i, n, *_ in rest)

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert all(r.token_ids == p.encode(texts[r.doc_id] or "") for r in cp.tokenize(spark, docs, sf).collect())


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit(1).alias("_id"))
    for d in (docs, docs.limit(0)):
        n = d.count()
        for i, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, d, sf)
            if i < 4:
                assert tuple(out.columns) == cp.COLUMNS, name
            rows = out.collect()
            assert len(rows) <= n and (n == 0 or len(rows) > 0), name
            nulls = [r for r in rows if i < 4 and r.text is None]
            assert len(nulls) == (0 if i == 4 or n == 0 else 2), name  # null texts go through every stage
