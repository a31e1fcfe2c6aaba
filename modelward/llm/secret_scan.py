"""Secrets in texts: fixed forms, and long strings whose characters are spread as in random keys."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base forms.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character that a window must exceed, by the class of its characters: hexadecimal digits, no digits, all others.
THRESHOLDS = {"hex": 3.05, "letters": 4.0, "mixed": 3.81}
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Candidates that match as a whole are never reported: identifiers of rows.
ALLOWED = ("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",)
#: Windows that touch one of these, in either case, are never judged: sample values, alphabets.
ALLOWED_WORDS = ("example", "sample", "placeholder", "changeme", "xxxx", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "1234567890123456")
BLANK = "~"
#: Matches whose places are found in one fold.
FOLD = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it stands in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of ``start, end, value``; value is the given group.

    The lengths of the pieces between matches give the places, in code points.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)")
    length = lambda x: x["gap"] + F.coalesce(F.char_length(x["whole"]).cast("long"), F.lit(0).cast("long"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = state["at"] + length(x)
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("done"))

    # A fold copies what it has gathered at each step, so many matches are folded in parts: first their lengths, then each
    # part from where it begins.
    cut = lambda steps: F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / FOLD).cast("int")), lambda k: F.slice(steps, k * FOLD + 1, F.lit(FOLD)))
    zero = F.lit(0).cast("long")
    begins = lambda parts: F.aggregate(parts, F.array(zero), lambda done, part: F.concat(done, F.array(F.element_at(done, -1) + F.aggregate(part, zero, lambda n, x: n + length(x)))))
    folded = lambda p: F.aggregate(p["part"], F.struct(p["begin"].alias("at"), none.alias("done")), step, lambda s: s["done"])
    places = lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(begins(parts), F.lit(1), F.size(parts)).alias("begin")), folded))
    every = let(steps, lambda steps: let(cut(steps), places))
    # The last piece has no match after it.
    return F.filter(every, lambda x: x["value"].isNotNull())


def _marked(alphabet: Column, pattern: str) -> Column:
    """1 for each character that the pattern knows, else 0."""
    return F.transform(alphabet, lambda c: c.rlike(pattern).cast("int"))


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of a window sliding over the candidate, in bits above the threshold of its class.

    Counts are carried from window to window: one character comes in, one goes out. Those of the characters give the sum of
    ``c * log2(c)``; those of letters, digits and letters beyond f tell the class. Windows without letters, and those that
    hold a BLANK, are not judged.
    """
    kinds = {"blanks": BLANK, "digits": "[0-9]", "letters": "[A-Za-z]", "beyond": "[^0-9A-Fa-f]"}
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def peak(known: Column) -> Column:
        alphabet, places, marks = known["alphabet"], known["places"], {name: known[name] for name in kinds}
        start = F.struct(F.transform(alphabet, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), *[F.lit(0).alias(name) for name in kinds])

        def step(state, i):
            come, go = F.get(places, i), F.when(i >= window, F.get(places, i - window)).otherwise(F.lit(-1))
            grown = F.get(state["counts"], come)
            counts = F.transform(state["counts"], lambda c, k: c + (k == come).cast("int") - (k == go).cast("int"))
            plus = F.get(weight, grown + 1) - F.get(weight, grown)
            shrunk = F.when(go == come, grown + 1).otherwise(F.get(state["counts"], go))
            minus = F.when(go < 0, F.lit(0.0)).otherwise(F.get(weight, shrunk) - F.get(weight, shrunk - 1))
            total = state["sum"] + plus - minus
            seen = {name: state[name] + F.get(mark, come) - F.coalesce(F.get(mark, go), F.lit(0)) for name, mark in marks.items()}
            threshold = F.when(seen["beyond"] == 0, F.lit(THRESHOLDS["hex"])).when(seen["digits"] == 0, F.lit(THRESHOLDS["letters"])).otherwise(F.lit(THRESHOLDS["mixed"]))
            judged = (i >= window - 1) & (seen["blanks"] == 0) & (seen["letters"] > 0)
            bits = F.when(judged, F.lit(math.log2(window)) - total / window - threshold).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"), *[c.alias(name) for name, c in seen.items()])

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda s: s["best"])

    def read(chars: Column) -> Column:
        place = lambda alphabet: F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1)
        return let(F.array_distinct(chars), lambda a: let(F.struct(a.alias("alphabet"), place(a).alias("places"), *[_marked(a, p).alias(name) for name, p in kinds.items()]), peak))

    return let(F.split(candidate, ""), read)


def suspicious(candidate: Column) -> Column:
    """Whether a candidate is not allowed as a whole and has a window above the threshold of its class."""
    plausible, text = candidate.rlike("[A-Za-z]"), candidate
    for pattern in ALLOWED:
        plausible &= ~candidate.rlike(pattern)
    for word in ALLOWED_WORDS:
        text = F.regexp_replace(text, F.lit(f"(?i){word}"), F.lit(BLANK * len(word)))
    # rounding of the running sum is no surplus
    return F.when(plausible, peak_entropy(text) > 1e-9).otherwise(F.lit(False))


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id and ``secrets``, an array of ``start, rank, end, kind, value`` by start, then kind.

    Kinds are ``assign``, ``access`` and ``hex`` by their forms, and ``entropy`` for other strings that pass
    ``suspicious`` and overlap none of the former. Places are code points of the whole text, the end exclusive.

    Null and empty texts have no secrets. A null id and repeated rows are kept as they are; other columns are not read; an
    empty table gives no rows. A text's length is bounded only by Spark's limit for a string.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)")
    # A plain test goes first: few texts hold a form, and the test stops at its first place.
    assign = F.when(text.rlike("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"), F.filter(found(text, ASSIGN, 2), lambda x: F.char_length(x["value"]) >= MIN_ASSIGNED)).otherwise(none)
    access = F.when(text.contains("AKIA"), F.filter(found(text, ACCESS), lambda x: F.char_length(x["value"]) >= MIN_ACCESS)).otherwise(none)
    runs = F.when(text.rlike(f"[0-9a-f]{{{MIN_HEX}}}"), F.filter(found(text, HEX), lambda x: F.char_length(x["value"]) >= MIN_HEX)).otherwise(none)
    dense = F.when(text.rlike(CANDIDATE), F.filter(found(text, CANDIDATE), lambda x: suspicious(x["value"]))).otherwise(none)
    named = lambda spans, rank: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), x["value"].alias("value")))
    base = F.concat(named(F.col("_assign"), 0), named(F.col("_access"), 1), named(F.col("_hex"), 2))
    apart = F.filter(F.col("_dense"), lambda x: ~F.exists(F.col("_base"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    rows = docs.select(F.col(id_column).alias("doc_id"), assign.alias("_assign"), access.alias("_access"), runs.alias("_hex"), dense.alias("_dense"))
    rows = rows.withColumn("_base", base)
    return rows.select("doc_id", F.array_sort(F.concat(F.col("_base"), named(apart, 3))).alias("secrets"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(secrets: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < 3)
    return secrets.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"),
    )
