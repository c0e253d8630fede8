"""Line dedup by a deletion-neighbourhood join; DataFrame expressions only.

A line is compared after white space runs became one space and the ends were
trimmed. A line is superseded if an earlier line, by (doc_id, line number),
equals it or, where both have `least` words or more, is one word away: inserted,
deleted or replaced. All superseded lines go; the earliest stays.

Lines are reduced to hashes at once; equal lines meet in an aggregate that
starts in the map tasks, so a line that fills a third of the corpus is one row
per task. The deletion neighbourhood of a distinct line is itself and itself
without each of its words. Two lines that are one word apart share all words of
one half, the words before or those behind the edit. Hence hashed keys are
emitted only for lines that share a half with a line of fitting length, and
only for words outside that half. A key is the exclusive or of hashes of words
at their places, so all variants of a line come from one running value, however
long it is. Within a key the earliest line is an aggregate and each other line
is held against it, so no pairs are formed; a match is verified on the words
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE, cut, fresh, read

#: Words from which on a line is compared with lines one word away, unless the caller says otherwise: one edit then leaves four fifths of its words or more.
MIN_WORDS = 5
#: Rows of a few numbers up to which a side of a join is broadcast; it is counted first, and beyond it both sides are shuffled.
SMALL_ROWS = 200_000


def _norm(line: Column) -> Column:
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))  # most lines need no pattern


def _small(df: DataFrame) -> DataFrame:
    """df, which is kept already, to be broadcast if it has up to SMALL_ROWS rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _lines(docs: DataFrame, id_col: str, text_col: str, halves: int = 0) -> DataFrame:
    """h1, h2 (the line), doc_id, line_no of each line with words; with halves, the least number of words that is compared, also nw (words) and the hashes of its halves, see _halves."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    x = x.select("doc_id", "line_no", _norm(F.col("line")).alias("norm")).where("norm != ''")
    found = [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), F.col("norm")).alias("h2"), F.col("doc_id"), F.col("line_no")]
    if halves:
        x = x.withColumn("nw", F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
        found += [F.col("nw"), *_halves(halves)]
    return x.select(*found)


#: Hashes of halves: the first and the last words of a line in the bucket of its word count n (k0, k1) and in that of n + 1 (k2, k3).
HALVES = ("k0", "k1", "k2", "k3")


def _halves(least: int) -> list[Column]:
    """Keys of the halves of norm, of nw words, in two buckets: lines of b and of b - 1 words meet in bucket b, where a half is (b - 1) // 2 words."""
    out = []
    for i, name in enumerate(HALVES):
        bucket = F.col("nw") + i // 2
        size = F.floor((bucket - 1) / 2).cast("int")
        half = F.call_function("substring_index", F.col("norm"), F.lit(" "), -size if i % 2 else size)
        out.append(F.when(F.col("nw") >= least, F.xxhash64(F.lit(i % 2), bucket, half)).alias(name))
    return out


def _candidates(distinct: DataFrame, least: int) -> DataFrame:
    """h1, h2, doc_id, line_no and held (bit i: HALVES[i] is shared) of the distinct lines that share a half with another line of their bucket."""
    k = distinct.where(F.col("nw") >= least).select("h1", F.posexplode(F.array(*HALVES)).alias("i", "k"))
    shared = cut(k.groupBy("k").count().where("count > 1").select("k"))
    found = cut(k.join(_small(shared), "k", "left_semi").groupBy("h1").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("held")))
    return cut(distinct.where(F.col("nw") >= least).join(_small(found), "h1").select("h1", "h2", "doc_id", "line_no", "held"))


def _texts(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """lines with their normalised text, from the place where each stands first."""
    wanted = cut(lines.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2", "line_no", "held")).alias("lines_of")))
    wanted = F.broadcast(wanted) if lines.count() <= SMALL_ROWS else wanted
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    # Split before the wanted lines are spread, lest the text is split again for each of them.
    x = d.join(wanted, "doc_id").select("doc_id", F.split("text", "\n", -1).alias("lines"), "lines_of").select("doc_id", "lines", F.explode("lines_of").alias("x"))
    x = x.select("x.h1", "x.h2", "doc_id", "x.line_no", "x.held", _norm(F.get("lines", F.col("x.line_no"))).alias("norm"))
    # Rows that repeat an identifier: those that hold the line, each once.
    return x.where(F.xxhash64("norm") == F.col("h1")).dropDuplicates(["h1", "h2"])


def _keyed(texts: DataFrame) -> DataFrame:
    """h1, h2, n (words) and s: for the words outside the shared halves their place i (from 0) and v, the value of the line without the word."""
    w = F.split("norm", " ", -1)
    half = F.floor((F.col("n") - 1) / 2)
    front, back = F.col("held").bitwiseAND(1) != 0, F.col("held").bitwiseAND(2) != 0
    # Dealt by line before the words are spread, so that the running values need no exchange of words.
    d = texts.where(front | back).repartition("h1").select("h1", "h2", "held", w.alias("w"))
    # The words are split and counted in a step of their own, lest the line is split again for each of them.
    d = d.select("h1", "h2", "held", F.size("w").alias("n"), "w").select("h1", "h2", "held", "n", F.posexplode("w").alias("i", "w"))
    # Words behind the deleted one move up by a place: their hashes are those of u.
    d = d.select("h1", "h2", "n", "i", ((front & (F.col("i") >= half)) | (back & (F.col("i") < F.col("n") - half))).alias("out"), F.xxhash64("w", F.col("i") + 1).alias("t"), F.xxhash64("w", "i").alias("u"))
    line = Window.partitionBy("h1", "h2").orderBy("i")
    d = d.withColumn("x", F.col("t").bitwiseXOR(F.col("u")))
    run = F.bit_xor("x").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rest = F.bit_xor("u").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    v = run.bitwiseXOR(F.col("t")).bitwiseXOR(rest)
    return d.withColumn("v", v).where("out").groupBy("h1", "h2", "n").agg(F.collect_list(F.struct("i", "v")).alias("s"))


def _spread(keyed: DataFrame) -> DataFrame:
    """A row per word of each line outside its shared halves: h1, h2, n, at (its place from 1 on), r (key of the line without it, for lines of equal length that lack the same place) and k (key of the line without it, as a line)."""
    d = keyed.select("h1", "h2", "n", F.inline("s"))
    return d.select("h1", "h2", "n", (F.col("i") + 1).alias("at"), F.xxhash64("v", F.col("i") + 1, "n").alias("r"), F.xxhash64("v", F.col("n") - 1).alias("k"))


def _whole(texts: DataFrame) -> DataFrame:
    """k, g1, g2: the key of each line as it stands."""
    w = F.split("norm", " ", -1)
    value = F.aggregate(F.transform(w, lambda x, i: F.xxhash64(x, i + 1)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    shorter = F.col("held").bitwiseAND(12) != 0  # shares a half with a line of one word more
    return texts.where(shorter).select(F.xxhash64(value, F.size(w)).alias("k"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))


def _nearest(texts: DataFrame, least: int) -> DataFrame:
    """h1, h2 of candidate lines that an earlier line is one word away from."""
    d = _spread(cut(_keyed(texts)))
    often = cut(d.groupBy("r").count().where("count > 1").select("r", F.lit(True).alias("often")))
    short = cut(_whole(texts))
    hits = d.join(_small(often), "r", "left").join(_small(short), "k", "left").where(F.col("often") | (F.col("g1").isNotNull() & (F.col("n") > least)))
    first = texts.select("h1", "h2", F.struct("doc_id", "line_no").alias("first"))
    hits = cut(hits.select("h1", "h2", "at", "r", "often", F.when(F.col("n") > least, F.col("g1")).alias("g1"), "g2").join(first, ["h1", "h2"]))
    # Replaced: the same value without the word at the same place. The earliest line of a key stands for all earlier ones.
    same = hits.where("often").select("h1", "h2", "first", "r", "at")
    least = same.groupBy("r").agg(F.min(F.struct("first", "h1", "h2")).alias("m"))
    replaced = same.join(least, "r").where("first > m.first").select("h1", "h2", "at", F.lit("r").alias("how"), F.col("m.h1").alias("g1"), F.col("m.h2").alias("g2"))
    # Deleted: a line without a word is another line as it stands.
    hit = hits.where("g1 IS NOT NULL").join(first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("first2")), ["g1", "g2"]).where("first != first2")
    later = F.col("first2") < F.col("first")
    side = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    moved = hit.select(side("h1", "g1").alias("h1"), side("h2", "g2").alias("h2"), "at", F.when(later, "d").otherwise("i").alias("how"), side("g1", "h1").alias("g1"), side("g2", "h2").alias("g2"))
    pairs = replaced.unionByName(moved).dropDuplicates(["h1", "h2", "g1", "g2"])
    x = texts.select("h1", "h2", F.split("norm", " ", -1).alias("x"))
    y = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.split("norm", " ", -1).alias("y"))
    both = pairs.join(x, ["h1", "h2"]).join(y, ["g1", "g2"])
    without = lambda c: F.concat(F.slice(c, F.lit(1), F.col("at") - 1), F.slice(c, F.col("at") + 1, F.size(c)))
    true = F.when(F.col("how") == "r", without("x") == without("y")).when(F.col("how") == "d", without("x") == F.col("y")).otherwise(F.col("x") == without("y"))
    return both.where(true).select("h1", "h2").distinct()


def superseded_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, bound: int = 1) -> DataFrame:
    """doc_id and gone: line_no (from 0) and h1 of the lines that go, of each document with such lines."""
    if least < 1 or bound not in (0, 1):
        raise ValueError("least must be 1 or more, and bound 0 or 1")
    lines = _lines(docs, id_col, text_col, halves=least)
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("x"), F.count("*").alias("c"), *[F.min(x).alias(x) for x in ("nw", *HALVES)])
    distinct = cut(distinct.select("h1", "h2", "x.doc_id", "x.line_no", "c", "nw", *HALVES))
    if bound:
        near = cut(_nearest(cut(_texts(docs, _candidates(distinct, least), id_col, text_col)), least))
    else:
        near = distinct.select("h1", "h2").limit(0)
    late = distinct.select("h1", "h2", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"), "c").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("c > 1 OR near").drop("c")
    late = cut(late)
    held = _lines(docs, id_col, text_col).join(_small(late), ["h1", "h2"])
    gone = held.where(F.col("near").isNotNull() | (F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line")))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "h1")).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, bound: int = 1) -> DataFrame:
    """docs with text cut down to the lines that stay, and n_lines, n_dropped (lines with words, and those that went).

    bound is the number of words that may be inserted, deleted or replaced, 1 or
    0; least the number of words from which on lines are compared so, 1 or more.
    Shorter lines, and all with bound 0, go only where they equal an earlier one.

    Lines end with a line feed; lines without words are never dropped. A null
    or empty text and a row with a null identifier are left as they are, and
    their lines supersede none. Rows that repeat an identifier and its text are
    one document: its lines do not supersede themselves. Other columns pass;
    those named n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    key, gone, lines, own = fresh(docs, "id", "gone", "lines", "own")
    found = superseded_lines(docs, id_col, text_col, least, bound).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    x = docs.join(found, docs[id_col].cast("long") == found[key], "left")
    # The lines are a column of their own, lest a lambda splits the text for each of them.
    x = x.withColumn(lines, F.split(F.col(text_col), "\n", -1))
    # The hash tells the texts of a repeated identifier apart.
    true = F.transform(F.filter(gone, lambda g: F.xxhash64(_norm(F.get(F.col(lines), g["line_no"]))) == g["h1"]), lambda g: g["line_no"])
    x = x.withColumn(own, F.when(F.col(gone).isNotNull(), true))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own))
    text = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.filter(lines, lambda s: s.rlike(r"[^\x20\x09-\x0D]")))).cast("long")
    return x.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce(F.size(own), F.lit(0)).cast("long"), text_col: text}).drop(key, gone, lines, own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays of every document."""
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, trim(regexp_replace(ls[i + 1], '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
f AS (SELECT s, string_split(s, ' ') AS w, min((doc_id, i)) AS p FROM l WHERE s <> '' GROUP BY s),
v AS (SELECT s, p, k, len(w) AS n, array_to_string(list_concat(w[:k - 1], w[k + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM f WHERE len(w) >= {MIN_WORDS})),
r AS (SELECT v, k, n, min(p) AS p FROM v GROUP BY v, k, n),
near AS (
  SELECT v.s FROM v JOIN r ON v.v = r.v AND v.k = r.k AND v.n = r.n WHERE r.p < v.p
  UNION SELECT v.s FROM v JOIN f ON v.v = f.s WHERE v.n > {MIN_WORDS} AND f.p < v.p
  UNION SELECT f.s FROM v JOIN f ON v.v = f.s WHERE v.n > {MIN_WORDS} AND v.p < f.p),
g AS (SELECT l.doc_id, list(l.i) AS gone FROM l JOIN f USING (s) WHERE (l.doc_id, l.i) <> f.p OR l.s IN (SELECT s FROM near) GROUP BY l.doc_id)
SELECT doc_id, coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""
