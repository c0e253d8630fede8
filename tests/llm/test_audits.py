"""HTML extraction, filter audit and source divergence."""

import random
import re
import time
from collections import Counter, defaultdict
from html import unescape
from itertools import permutations

import numpy as np
import pytest

from locusframe.llm import divergence, filter_audit, html_text
from locusframe.llm.page_tree import MAX_DEPTH, Page
from tests.llm.conftest import ROWS
from tests.llm.test_simple_ops import SF


def text_of(page, low=frozenset()):
    return html_text._text(Page(page), set(low))[0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("no markup at  all", "no markup at all"),
        ("<p>a<p>b<br>c</p>d", "a b c d"),
        ("<p>one<b>two<i>three</b>four</i></p>five", "onetwothreefour five"),
        ("<article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>", "T x y"),
        ("<nav>menu</nav><header>top</header><article><header><h1>Title</h1></header><p>text</p><footer>by me</footer></article>", "Title text"),
        ("<p>a &amp; b &lt;tag&gt; &#65;&#x42; &eacute;&copy &am</p>", "a & b <tag> AB é© &am"),
        ("<p>&nbsp; a&nbsp;b\t\n c</p>", "a b c"),
        ("a < b and 1<2 </> c", "a < b and 1<2 c"),
        ("x<!-- <p>no</p> -- > --><!-->y<!--->z<!-- open", "xyz"),
        ("<script>if (a</b) '</p>'</script>t<style>p{}</style><textarea>no</textarea>u<title>no", "tu"),
        ('<p title="a > b" class=x data-y=\'>\'>in</p><p title="open>z</p>', "in z"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a b c"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"),
        ("<div class='ad'>buy</div><div class='AdSlot top'>buy</div><div class='adobe'>kept</div><div class='no-ads'>kept too</div>", "kept kept too"),
        ("<body class='has-sidebar comments-open'><p>kept</p><div id='sidebar-2'>no</div>", "kept"),
        ("<p>a <span class='share'>tweet <span>me</span> now</span> b</p>", "a b"),
        ("<p>a <span class='ad'>never closed</p><p>b</p>", "a b"),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
        ("<article><p>story</p><article>nice!</article><div class='comments'><p>first</p></div></article>", "story"),
        ("<article><p>story</p></article><div class='comments'><article><p>me</p></article></div>", "story"),
        ("<div class='sidebar-layout'><article><p>story</p></article></div><div>other</div>", "story"),
        ("<form id='aspnet'><div><p>whole page in a form</p></div></form>", "whole page in a form"),
        ("<form><input>login</form><p>text</p>", "text"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"),
        ("<main><p>m</p><aside><article><p>a</p></article></aside></main>", "m"),
        ("<div role=main><p>m</p></div><p>out</p>", "m"),
        ("<nav>only a menu</nav>", ""),
        ("<article></article><p>outside</p>", "outside"),
        ("<p>breaks off <b>here", "breaks off here"),
        ("<p>breaks off <a href='x", "breaks off"),
        ("</p></div></article>stray<p/>ends", "stray ends"),
        ("<P CLASS=AD>x</P><H1>Big</H1>", "Big"),
        ("<x-y>un<z>known</z></x-y>", "unknown"),
    ],
)
def test_page(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("piece", ["<div>x", "<p class='", "<!--", "<", "</", "<a href=\"x\"", "<script>", "&", "<b>y", "<article>z", "<li>q", "=\"'", "<td>w", "</div>"])
def test_page_in_linear_time(piece):
    took = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        Page(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0] + 0.2


def test_deep_pages_keep_their_text():
    page = Page("".join(f"<div>{i} " for i in range(3 * MAX_DEPTH)) + "</div>" * 3 * MAX_DEPTH + "end")
    assert " ".join(t for _, t, _ in page.main_blocks()).split() == [str(i) for i in range(3 * MAX_DEPTH)] + ["end"]


def soup(i, extra=""):
    return (
        f"<html><body><div class='top'><a href='/'>Home</a> <a href='/about'>About us</a></div><div class='body'><h2>Story {i}</h2><p>Words of page {i} and {i * i}.</p><p>All rights to every story are ours.</p>{extra}</div>"
        f"<div class='low'>Made by the same people since 1999</div></body></html>"
    )


def test_style_tree_takes_out_what_a_site_repeats(spark):
    rows = [(i, f"http://a.example/{i}", soup(i), 1, "x") for i in range(8)]
    rows += [(100 + i, f"https://user@A.example:8080/copy{i}", soup(3), 1, "x") for i in range(30)]  # copies count once
    rows += [(200, "http://other.example/", soup(50), 1, "x"), (201, None, soup(51), 1, "x"), (202, "no url", soup(51), 1, "x"), (203, None, None, 1, "x"), (None, "http://a.example/x", "", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node int, digest string")
    for bound in (1000, -1):  # broadcast and joined
        got = sorted(((r.page_id, r.text, r.n_chars, r.n_pruned) for r in html_text.extract(pages, broadcast=bound).collect()), key=repr)
        assert len(got) == len(rows)
        for i, text, n, pruned in got:
            assert n == len(text)
            if i in (203, None):
                assert (text, pruned) == ("", 0)
            elif i >= 200:
                assert text.startswith("Home About us Story") and text.endswith("1999") and pruned == 0
            else:
                k = 3 if i >= 100 else i
                assert (text, pruned) == (f"Story {k} Words of page {k} and {k * k}. All rights to every story are ours.", 2)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_importance_by_hand(spark):
    pages = spark.createDataFrame([(f"http://h.example/{i}", f"<div class='m'>{'same' if i < 6 else i}</div><div class='v'>{i}{'<i>x</i><ul><li>k</ul>' if i % 2 else '<ol><li>k</ol>'}</div>") for i in range(8)], "url string, html string")
    got = {round(r.content, 6): r for r in html_text.style_tree(pages).collect()}
    h = 6 / 8 * np.log(6) / np.log(8)  # six of eight shown texts occur on six pages
    same = got[round(1 - h, 6)]
    assert same.pages == 8 and same.importance == pytest.approx(1 - h)
    mixed = got[1.0] if 1.0 in got else None
    assert mixed is not None and mixed.presentation == pytest.approx(np.log(2) / np.log(8)) and mixed.importance == pytest.approx((1 - 0.9**2) * np.log(2) / np.log(8) + 0.9**2)


def test_copies_of_a_site_keep_their_text(spark):
    pages = spark.createDataFrame([(i, f"http://m.example/{i}", "<div>one text on all pages</div>") for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"one text on all pages"}


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.query(spark, SF).collect()}
    for p in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        assert got[p.page_id] == " ".join(filter(None, blocks))


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = word.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs)
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("held", [1, 7, 10_000])
def test_audit_against_trial(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_TEXTS", held)
    monkeypatch.setattr(filter_audit, "HELD_PARTS", min(held, 256))
    monkeypatch.setattr(filter_audit, "_CHUNK", 50)
    rnd = random.Random(held)
    texts = [" ".join(rnd.choice(["a", "B", "C$", f"w{rnd.randrange(200)}", f"W{rnd.randrange(200)}"]) for _ in range(rnd.choice([3, 90, 110, 150]))) for _ in range(12)] + [None, "", "é" * 9 + "A", "\x1c \x85 x"]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(i, texts[0], "xx") for i in (3, 3, 4)] + [(i, t, "odd") for i, t in ROWS]
    labels = [(rnd.choice([None, *range(40)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(40)]
    d = spark.createDataFrame([(i, t, x, "k", 1, b"") for i, t, x in docs], "doc_id long, text string, lang string, part string, mask int, digest binary")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == brute_audit(docs, labels) and got.count() == 600 * 5


def test_audit_of_nothing(spark):
    d, labels = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d.limit(0), labels).count() == 0
    assert filter_audit.audit(d, labels).count() == 600
    assert filter_audit.audit(d, labels, filter_audit.Limits(words=0)).where("removed > 0").count() == 0


# ---------------------------------------------------------------- divergence


def brute_divergence(docs, least, top):
    docs = [tuple(v or "" for v in r) for r in docs]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in docs]
    groups, out = {(lang, s) for lang, s, _ in found}, set()
    for lang in {g[0] for g in groups}:
        df, counts = Counter(), defaultdict(Counter)
        for x, source, terms in found:
            if x == lang:
                df.update(set(terms))
                counts[source].update(terms)
                counts[None].update(terms)
        kept = [t for t in df if df[t] >= least]
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        share = {s: {t: 1 + 10**9 * (counts[s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in counts}
        sources = [s for x, s in groups if x == lang]
        for s in sources:
            pairs = [("pair", o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            marks = [("term", t, share[s][t] - share[None][t]) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for rows, most in ((pairs, None), (marks, top)):
                for rank, (part, item, value) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize(("width", "held"), [(1 << 16, 400_000), (64, 5), (3, 1)])
def test_divergence_against_trial(spark, monkeypatch, width, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rnd = random.Random(width)
    words = ["The", "the", "é1é", "x-y", "naïve", "Z", "q_q", "\x85a", "你好"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(rnd.choice(["en", "de", None, "", "lone"]), rnd.choice(["a", "b", "ü", None, ""]), " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=rnd.randrange(12)))) for _ in range(200)]
    docs += [("en", "empty", None), ("few", "s", "unseen words"), ("few", "t", ""), ("lone", "a", "x " * 500)] + [("odd", "s", t) for _, t in ROWS]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "lang string, source string, text string, n int, term string")
    out = divergence.divergence(d, min_docs=8, top=4, width=width)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(docs, 8, 4)
    assert divergence.divergence(d.limit(0)).count() == 0


def test_divergence_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10**17, 10**18, 7)], "n long, total long, v long")
    assert rows.select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 35)


def test_sketch_never_underestimates(spark):
    rnd, keys = random.Random(1), [str(i).encode() for i in range(3000)]
    whole, sketch, parts = Counter(), divergence.Sketch(30, 512), []
    for _ in range(20):
        c = Counter(rnd.choices(keys, [1 / (i + 1) for i in range(3000)], k=2000))
        whole.update(c)
        sketch.add(c)
        parts.append(divergence.Sketch(30, 512))
        parts[-1].add(c)
    summed = np.minimum(sum(p.counters.astype(int) for p in parts), 30)
    may = sketch.may_reach(keys)
    assert (summed >= 30).tolist() == (sketch.counters >= 30).tolist()
    assert all(m for k, m in zip(keys, may) if whole[k] >= 30) and not may.all()
    docs = spark.createDataFrame([("en", "s", " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(k, k + 300))) for k in range(40)], "lang string, source string, text string")
    merged = divergence.sketch_frequencies(docs)
    everything = {r.term: r.docs for r in divergence.count_terms(docs, None).collect()}
    sieved = {r.term: r.docs for r in divergence.count_terms(docs, merged).collect()}
    assert sieved == {t: n for t, n in everything.items() if n >= 30} and len(sieved) < len(everything)
