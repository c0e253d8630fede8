"""Personal data: proposed by regular expressions, confirmed by checksums, weighed by context words.

All of it is DataFrame expressions. A pattern's matches and the pieces between
them (split by the same pattern) have lengths whose running sums are positions,
so no text leaves the JVM. The patterns start only at the left edge of a run of
characters that may begin a match, or where the last match ended, and use
possessive quantifiers: the same leftmost matches, in time linear in the text.

Every match has a score: what its kind and checksum speak for, more with words
near it that name such data, less with words that deny it (examples, part
numbers). The four base kinds are returned as they are defined, whatever their
score. Two further kinds, IBANs (mod 97) and national identity numbers, are
added from THRESHOLD on, so that context decides about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import id_text, read

THRESHOLD = 0.6
#: Matches whose positions are summed at one go; longer lists are summed block by block.
BLOCK = 128
#: Code points before and after a match, up to the next one of its kind, in which context words count.
NEAR = 40

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

#: By kind: score of a confirmed match, and words near it that speak for such data.
EVIDENCE = {
    "email": (0.8, r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": (0.5, r"(?i)\b(?:ip|address|host|server|client|login)\b"),
    "card": (0.7, r"(?i)\b(?:card|visa|mastercard|credit|debit|pay|payment)\b"),
    "phone": (0.6, r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b"),
    "iban": (0.7, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer|bic|swift)\b"),
    "ssn": (0.4, r"(?i)\b(?:ssn|social|security|identity|id|number)\b"),
}
#: Words near a match that speak against it, and what words for and against are worth.
AGAINST = r"(?i)\b(?:example|sample|dummy|fake|test|version|part|serial|sku|isbn|model)\b"
FOR_WORTH, AGAINST_WORTH = 0.25, 0.2


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = digits.substr(n - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 1, x * 2).otherwise(x)
        return acc + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1, its first four characters put last and letters read as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        a = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(a >= 65, (acc * 100 + a - 55) % 97).otherwise((acc * 10 + a - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_PLACES = "array<struct<m:string,s:int,e:int,near:string>>"


def running(steps: Column) -> Column:
    """Sums of the elements before each element. Blocks are summed first, so that only BLOCK sums at a time are copied as they grow."""
    n = F.size(steps)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))

    def scan(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    starts = scan(sums, F.lit(0))
    return F.flatten(F.transform(starts, lambda at, b: scan(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), at)))


def _located(kind: str) -> Column:
    """Structs m (match), s (start), e (end), near (the match and what stands beside it) of all matches, from the columns <kind>_m and <kind>_p (matches and pieces between)."""
    m, p, before = F.col(f"{kind}_m"), F.col(f"{kind}_p"), F.col(f"{kind}_r")

    def place(x: Column, i: Column) -> Column:
        s = F.get(before, i) + F.length(F.get(p, i))
        # Cut from the pieces beside the match: to look into the text at a place takes as long as all that stands before it.
        near = F.concat(F.right(F.get(p, i), F.lit(NEAR)), x, F.left(F.get(p, i + 1), F.lit(NEAR)))
        return F.struct(x.alias("m"), s.alias("s"), (s + F.length(x)).alias("e"), near.alias("near"))

    return F.when(F.size(m) > 0, F.transform(m, place)).otherwise(F.array().cast(_PLACES))


def _steps(kind: str) -> Column:
    """Code points from the end of each match's predecessor to its own end."""
    m, p = F.col(f"{kind}_m"), F.col(f"{kind}_p")
    steps = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(p, i)))
    return F.when(F.size(m) > 0, running(steps))


def _valid(kind: str) -> Column:
    found = F.col(f"{kind}_l")
    if kind == "email":
        return found
    if kind == "ip":
        return F.filter(found, lambda x: F.forall(F.split(x["m"], r"\."), lambda part: F.length(F.regexp_replace(part, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(x["m"], r"\."), lambda part: F.coalesce(F.substring(F.regexp_replace(part, "^0+(?=[0-9])", ""), 1, 4).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.filter(found, lambda x: F.length(_digits(x["m"])).between(16, 19) & luhn(F.substring(_digits(x["m"]), 1, 19)))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(_digits(x["m"])).between(8, 15))
    if kind == "iban":
        return F.filter(found, lambda x: mod97(F.regexp_replace(x["m"], " ", "")))
    return found


def _scored(kind: str) -> Column:
    """The confirmed matches with their scores, from the column <kind>_v."""
    worth, words = EVIDENCE[kind]

    def add(x: Column) -> Column:
        score = F.lit(worth) + F.when(x["near"].rlike(words), FOR_WORTH).otherwise(0.0) - F.when(x["near"].rlike(AGAINST), AGAINST_WORTH).otherwise(0.0)
        return F.struct(x["m"].alias("m"), x["s"].alias("s"), x["e"].alias("e"), F.round(score, 2).alias("score"))

    out = F.transform(f"{kind}_v", add)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= THRESHOLD)


#: In the order of the output. A text without the hint's characters holds no match.
KINDS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+"), "iban": (IBAN, None), "ssn": (SSN, "-")}
BASE = ("email", "ip", "card", "phone")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id and, per kind, an array of spans (m match, s start, e end in code points, end exclusive, score).

    Null counts as empty; a text without personal data has empty arrays; an
    empty table gives no rows; repeated rows get their own result each. Matches
    do not overlap within a kind. Other columns stay outside.
    """
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    for kind, (pattern, hint) in KINDS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        d = d.withColumn(f"{kind}_m", found if hint is None else F.when(F.instr("text", hint) > 0, found).otherwise(none))
    d = d.withColumns({f"{k}_p": F.when(F.size(f"{k}_m") > 0, F.split("text", pattern, -1)).otherwise(none) for k, (pattern, _) in KINDS.items()})
    for step, made in (("r", _steps), ("l", _located), ("v", _valid)):
        d = d.withColumns({f"{k}_{step}": made(k) for k in KINDS})
    return d.select("doc_id", *[_scored(k).alias(k) for k in KINDS])


def _joined(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    parts = [named(k) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and hash of the base kinds, all spans and their scores of every document."""
    found = find_pii(read(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform(F.concat(*KINDS), lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(tuple(KINDS)).alias("spans"), scores.alias("scores"))
