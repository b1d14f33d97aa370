"""Secret scan: fixed patterns plus sliding-window Shannon entropy, in DataFrame functions only.

Positions come from splitting a text by a pattern: the lengths of the parts between the matches and of the
matches themselves add up to every match's start. Candidate strings of a character class (hexadecimal,
base64) are slid over with a fixed window whose symbol counts, and the sum of n*log2(n) that the entropy
needs, are updated by the symbol that enters and the one that leaves. A candidate's span runs from its first
to its last window over the class's threshold. An allow-list suppresses candidates that are no secrets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which their kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its candidates, alphabet, window and the least entropy (bits a symbol) of a secret."""

    kind: str
    candidates: str
    alphabet: str
    window: int
    least: float


DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sixteen symbols can reach 4 bits, sixty-six in 24 places 4.58.
CLASSES = (
    EntropyClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", DIGITS + "abcdef", 24, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", DIGITS + UPPER + UPPER.lower() + "+/_-", 24, 3.9),
)
#: Candidates that match one of these are no secrets: no digit or no letter, placeholders, identifiers written in groups.
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"(?i)example|placeholder|changeme|xxxx", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def located(text: Column, pattern: str, rank: int, kind: str, hint: Column) -> Column:
    """All leftmost non-overlapping matches as spans, with the matched text in ``value``; none without the ``hint``."""
    lit = F.lit(pattern)
    # each part is followed by a match, but for the last
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    steps = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    shape = "struct<at:int,out:array<struct<start:int,rank:int,end:int,kind:string,value:string>>>"
    state = F.struct(F.lit(0).alias("at"), _none("struct<start:int,rank:int,end:int,kind:string,value:string>").alias("out")).cast(shape)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(s["out"], F.array(span)).alias("out")).cast(shape)

    all_found = F.aggregate(steps, state, step)["out"]
    return F.when(hint & F.regexp_like(text, lit), all_found).otherwise(_none("struct<start:int,rank:int,end:int,kind:string,value:string>"))


def hot_range(value: Column, c: EntropyClass) -> Column:
    """struct<first, last>: end places (from 1) of the first and last window over the threshold; 0 if there is none."""
    n = len(c.alphabet)
    folded = F.lower(value) if c.alphabet.upper() != c.alphabet and UPPER not in c.alphabet else value
    symbols = F.transform(F.split(folded, "", -1), lambda x: F.instr(F.lit(c.alphabet), x))
    # sum of n*log2(n) that a window may have at most: the entropy is log2(window) - sum / window
    most = c.window * (math.log2(c.window) - c.least) + 1e-9
    weight = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(c.window + 1)])
    shape = "struct<counts:array<int>,sum:double,first:int,last:int>"
    state = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last")).cast(shape)

    def scan(indexed: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            comes = F.get(indexed, i - 1)
            goes = F.when(i > c.window, F.get(indexed, i - 1 - c.window)).otherwise(F.lit(0))
            more, less = F.get(s["counts"], comes - 1), F.coalesce(F.get(s["counts"], goes - 1), F.lit(0))
            gain = F.get(weight, more + 1) - F.get(weight, more)
            loss = F.when(goes > 0, F.get(weight, less) - F.get(weight, less - 1)).otherwise(F.lit(0.0))
            total = s["sum"] + F.when(comes == goes, F.lit(0.0)).otherwise(gain - loss)
            counts = F.when(comes == goes, s["counts"]).otherwise(F.transform(s["counts"], lambda x, j: x + (j == comes - 1).cast("int") - (j == goes - 1).cast("int")))
            hot = (i >= c.window) & (total <= most)
            first = F.when(hot & (s["first"] == 0), i).otherwise(s["first"])
            return F.struct(counts.alias("counts"), total.alias("sum"), first.alias("first"), F.when(hot, i).otherwise(s["last"]).alias("last")).cast(shape)

        return F.aggregate(F.sequence(F.lit(1), F.size(indexed)), state, step)

    # a one-element array binds the symbols to a name: they are computed once
    return F.get(F.transform(F.array(symbols), scan), 0)


def entropy_spans(text: Column, c: EntropyClass, rank: int, base: Column) -> Column:
    """Spans of candidates with hot windows that neither the allow-list nor a base span covers."""
    # the allow-list lets no candidate through that has no digit
    found = located(text, c.candidates, rank, c.kind, F.col("digits"))
    allowed = lambda v: ~F.regexp_like(v, F.lit("|".join(f"(?:{p})" for p in ALLOW)))
    free = F.filter(found, lambda m: allowed(m["value"]) & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    ranges = F.transform(free, lambda m: F.struct(m["start"].alias("at"), hot_range(m["value"], c).alias("hot")))
    spans = F.transform(F.filter(ranges, lambda r: r["hot"]["last"] > 0), lambda r: F.struct((r["at"] + r["hot"]["first"] - c.window).cast("int").alias("start"), F.lit(rank).alias("rank"), (r["at"] + r["hot"]["last"]).cast("int").alias("end"), F.lit(c.kind).alias("kind")))
    return F.when(F.size(found) > 0, spans).otherwise(_none()).cast(f"array<{SPAN}>")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """doc_id with its base spans and added entropy spans, arrays of (start, rank, end, kind) in order."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    # of an assignment's match, the part behind the last separator is its second group
    long_enough = F.filter(located(text, ASSIGN, 0, "assign", F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    own = own.withColumns({"assign": plain(long_enough), "access": plain(located(text, ACCESS, 1, "access", F.contains(text, F.lit("AKIA")))), "hex": plain(located(text, HEX, 2, "hex", F.lit(True)))})
    own = own.withColumn("digits", F.regexp_like(text, F.lit("[0-9]")))
    own = own.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    added = F.concat(*[entropy_spans(text, c, 3 + k, F.col("base")) for k, c in enumerate(classes)])
    return own.withColumn("added", added)


def secret_scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row of ``docs(doc_id, text)``.

    A null text is the empty one: no spans, the digest of an empty string. Null ids and repeated rows stay;
    an empty table gives no rows; other columns are ignored. Spans count code points, the end is exclusive.
    One narrow projection: no shuffle, no Python.
    """
    found = secret_spans(docs, classes)
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
