"""Main text of HTML pages by site style trees.

The trees of a site's pages are merged: an element node of the merged tree is a
path of presentations (element, id, classes, digits folded) below a host, and a
style of it is the sequence of its children's presentations. A node's
presentation is important when its styles vary over the pages, and its content
when its texts and links differ between the pages: both are entropies, from
counts that Spark sums by (node, style) and (node, text). Pages with the same
main text count once, so copies do not speak against their own text. A page is
then read again without the branches of low importance.

What HTML itself names is decided first: menus, headers, footers, asides, forms,
adverts and comments go by element, role or name, and where a page names its
article nothing outside it is text. Within a named article running text stays;
of the rest, and of pages that name no article, the style tree decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import cut, read, slices
from locusframe.llm.page_tree import Page

#: Importance under which a branch goes, pages that must show it, and the weight of content for each style of a node.
THRESHOLD, MIN_PAGES, DAMPING = 0.3, 4, 0.9
#: Low branches up to which their keys (16 bytes each) are broadcast; beyond that pages are joined with them.
BROADCAST = 200_000
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_STYLE, _CONTENT = 0, 1


def site_of(url: str | None) -> str:
    """The host of a URL, in lower case; empty if it has none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _value(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _observed(page: Page) -> tuple[bytes, list[tuple[bytes, int, int, int, int]]]:
    """Digest of a page's main text, and (node, kind, value, n, first) rows: styles and contents of its nodes and how often it shows them; first marks one row a node."""
    main = page.main_blocks()
    wanted, texts = {}, Counter()
    for node, text, _ in main:
        texts[node.key, _CONTENT, _value(text.encode("utf-8", "surrogatepass"))] += 1
        wanted[id(node)] = node
    for node in wanted.values():
        texts[node.key, _STYLE, int.from_bytes(node.style, "big") - (1 << 63) if node.style else 0] += 1
        for link in node.links:
            texts[node.key, _CONTENT, _value(b"\x00" + link.encode("utf-8", "surrogatepass"))] += 1
    seen, rows = set(), []
    for (key, kind, value), n in texts.items():
        rows.append((key, kind, value, n, int(key not in seen)))
        seen.add(key)
    return xxhash.xxh3_128_digest("\n".join(t for _, t, _ in main).encode("utf-8", "surrogatepass")), rows


def _pages(batches: Iterator[pa.RecordBatch], html_at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for batch in batches:
        for piece in slices(batch, html_at):
            for i in range(0, piece.num_rows, 64):
                few = piece.slice(i, 64)
                yield few, [Page(h, site_of(u)) for u, h in zip(few.column(0).to_pylist(), few.column(html_at).to_pylist(), strict=True)]


_NODES = "array<struct<key: binary, kind: int, value: long, n: long, first: long>>"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = pa.struct([("key", pa.binary()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])
    names = [f.name for f in row]
    for few, pages in _pages(batches):
        sites = [site_of(u) for u in few.column(0).to_pylist()]
        seen = [(s, *_observed(p)) for s, p in zip(sites, pages, strict=True) if s]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _, _ in seen], pa.string()), pa.array([d for _, d, _ in seen], pa.binary()), pa.array([[dict(zip(names, r, strict=True)) for r in rows] for _, _, rows in seen], pa.list_(row))],
            names=["site", "digest", "nodes"],
        )


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per node of the sites' merged trees that shows text: node, pages, presentation, content and importance (0 to 1).

    The importance joins both as 1 - DAMPING ** styles parts of presentation and
    the rest content; a node without child elements has content alone. A node of
    a single page is important. Pages without a host belong to no site.
    """
    rows = pages.select(pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    seen = rows.mapInArrow(_observe, f"site string, digest binary, nodes {_NODES}").groupBy("site", "digest").agg(F.first("nodes").alias("nodes"))
    n = seen.select(F.explode("nodes").alias("o")).select("o.*")
    entropy = F.col("n") * F.log("n")
    shown = n.groupBy("key", "kind", "value").agg(F.sum("n").alias("n"), F.sum(entropy).alias("spread"), F.sum("first").alias("pages"))
    style, content = F.col("kind") == _STYLE, F.col("kind") == _CONTENT
    nodes = shown.groupBy("key").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.when(style, F.col("n"))).alias("n_style"),
        F.sum(F.when(style, entropy)).alias("style_spread"),
        F.sum(F.when(style & (F.col("value") != 0), 1).otherwise(0)).alias("styles"),
        F.sum(F.when(content, F.col("n"))).alias("n_content"),
        F.sum(F.when(content, entropy - F.col("spread"))).alias("content_spread"),
    )
    unit = F.log("pages")
    bounded = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    presentation = F.when(F.col("pages") > 1, bounded((F.log("n_style") - F.col("style_spread") / F.col("n_style")) / unit)).otherwise(1.0)
    content = F.when(F.col("pages") > 1, bounded(1 - F.col("content_spread") / F.col("n_content") / unit)).otherwise(1.0)
    nodes = nodes.select(F.col("key").alias("node"), "pages", "styles", presentation.alias("presentation"), content.alias("content"))
    weight = F.pow(F.lit(DAMPING), "styles")
    return nodes.select("node", "pages", "presentation", "content", F.round((1 - weight) * F.col("presentation") + weight * F.col("content"), 9).alias("importance"))


def _text(page: Page, low: set[bytes]) -> tuple[str, int]:
    """Main text without low branches, and how many blocks they held; a page of which nothing would stay keeps them."""
    main = page.main_blocks()
    kept = [text for node, text, running in main if running or node.key not in low]
    if not kept:
        return " ".join(text for _, text, _ in main), 0
    return " ".join(kept), len(main) - len(kept)


_SCHEMA = "page_id long, url string, text string, n_chars long, n_pruned long"


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, broadcast: int = BROADCAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points) and n_pruned (blocks that the style tree took out).

    A null or empty page has no text; pages without a host are cleaned by what
    they name alone. A page that breaks off keeps what it shows. Repeated rows
    get the same result each, and copies count once in their site's tree. An
    empty table gives no rows; other columns stay outside.
    """
    rows = pages.select(pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"), pages[id_col].cast("long").alias("page_id"))
    low = cut(style_tree(rows).where((F.col("pages") >= min_pages) & (F.col("importance") < threshold)).select("node"))

    def told(few: pa.RecordBatch, found: list[tuple[str, int]]) -> pa.RecordBatch:
        texts, pruned = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([few.column(2), few.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(pruned, pa.int64())], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    if low.count() <= broadcast:
        shared = pages.sparkSession.sparkContext.broadcast({bytes(r["node"]) for r in low.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for few, trees in _pages(batches):
                yield told(few, [_text(t, shared.value) for t in trees])

        return rows.mapInArrow(run, _SCHEMA)

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, trees in _pages(batches):
            keys = [list({n.key for n, _, running in t.main_blocks() if not running}) for t in trees]
            yield pa.RecordBatch.from_arrays([few.column(2), pa.array(keys, pa.list_(pa.binary()))], names=["digest", "keys"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, trees in _pages(batches):
            yield told(few, [_text(t, set(keys or ())) for t, keys in zip(trees, few.column(3).to_pylist(), strict=True)])

    digest = F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    known = rows.select("url", "html", digest.alias("digest")).mapInArrow(nodes_of, "digest string, keys array<binary>").select("digest", F.explode("keys").alias("node"))
    hit = known.join(low, "node", "left_semi").groupBy("digest").agg(F.collect_set("node").alias("keys"))
    return rows.withColumn("digest", digest).join(hit, "digest", "left").select("url", "html", "page_id", "keys").mapInArrow(run_joined, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
