"""Secrets in whole texts: three known forms, and strings whose characters look random.

Only DataFrame functions are used and no row leaves its place: there is no shuffle,
so a hot source or a very long text costs its own length.

The known forms are assignments to secret-like names, access key ids and runs of
hexadecimal digits. Of other strings, candidates are runs of at least WINDOW
characters of the base64 alphabets that hold a letter and a digit. A window of
WINDOW characters slides over each; the counts of its characters change by one
character out and one in, and so does the sum of c * log2(c) that its Shannon
entropy follows from. The greatest entropy over all windows is held against the
threshold of the character class. Candidates that are identifiers or checksums as a
whole are dropped. Words of placeholders cut a candidate into parts: no window
overlaps them, and each part is judged by itself.

Positions count code points. Java's matches give no positions, so a
text is also split at the matches; a match starts after all pieces and matches
before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known forms.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VALUE_CHARS = 12

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy in bits by class: (form of the whole candidate, threshold), the first that fits.
CLASSES = (
    (r"^[0-9a-f-]+$|^[0-9A-F-]+$", 3.0),
    (r"^[0-9a-z]+$|^[0-9A-Z]+$", 3.4),
    (r"", 3.7),
)
#: Whole candidates that are no secrets: identifiers and checksums.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^sha(256|384|512)-"
)
#: Words that no secret holds. Windows that overlap one are left out; the others count.
ALLOWED_WORDS = r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{5,}|abcdefghij|0123456789|1234567890"
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"
_CHUNK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column) -> Column:
    """Sum of all elements before each one. Sums of chunks keep the work near linear in the elements."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def places(part: Column) -> Column:
        return F.when(F.size(part) > 0, F.sequence(F.lit(0), F.size(part) - 1)).otherwise(F.array().cast("array<int>"))

    def of_chunks(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / _CHUNK).cast("int")
        chunks = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        sums = F.transform(chunks, lambda c: total(F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK))))
        return _let(sums, lambda s: F.transform(s, lambda x, c: total(F.slice(s, F.lit(1), c))))

    def one(all_: Column, before: Column, i: Column) -> Column:
        chunk = F.floor(i / _CHUNK).cast("int")
        return before[chunk] + total(F.slice(all_, chunk * _CHUNK + 1, i % _CHUNK))

    return _let(
        lengths, lambda all_: _let(of_chunks(all_), lambda before: F.transform(places(all_), lambda i: one(all_, before, i)))
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(begin, end, found) of all leftmost non-overlapping matches; found is the group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), between.alias("between"))
    # The text after the last match has no match of its own.
    zipped = F.filter(zipped, lambda z: z["whole"].isNotNull())

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda z: (F.length(z["between"]) + F.length(z["whole"])).cast("bigint"))
        return F.zip_with(
            found,
            prefix_sums(lengths),
            lambda z, before: F.struct(
                (before + F.length(z["between"])).alias("begin"),
                (before + F.length(z["between"]) + F.length(z["whole"])).alias("end"),
                z["part"].alias("found"),
            ),
        )

    return _let(zipped, placed)


def greatest_entropy(string: Column) -> Column:
    """The greatest Shannon entropy of WINDOW neighbouring characters, in bits; null for shorter strings."""
    weights = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    # What the sum changes by when a character's count reaches c.
    steps = F.array(F.lit(0.0), *(F.lit(weights[c] - weights[c - 1]) for c in range(1, WINDOW + 1)))
    numbers = F.transform(F.regexp_extract_all(string, F.lit("."), F.lit(0)), lambda ch: F.instr(F.lit(ALPHABET), ch))

    def over(all_: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("seen"),
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(None).cast("double").alias("least"),
        )

        def slid(state: Column, comes: Column) -> Column:
            full = state["seen"] >= WINDOW
            goes = F.when(full, all_[state["seen"] - WINDOW]).otherwise(F.lit(-1))
            same = comes == goes
            counts = F.when(same, state["counts"]).otherwise(
                F.transform(
                    state["counts"],
                    lambda c, k: c + F.when(k == comes, 1).otherwise(0) - F.when(k == goes, 1).otherwise(0),
                )
            )
            less = F.when(full, steps[F.when(full, state["counts"][F.greatest(goes, F.lit(0))]).otherwise(0)]).otherwise(0.0)
            sum_ = F.when(same, state["sum"]).otherwise(state["sum"] + steps[state["counts"][comes] + 1] - less)
            return _let(
                F.struct(counts.alias("counts"), sum_.alias("sum")),
                lambda new: F.struct(
                    (state["seen"] + 1).alias("seen"),
                    new["counts"].alias("counts"),
                    new["sum"].alias("sum"),
                    F.when(state["seen"] + 1 >= WINDOW, F.least(state["least"], new["sum"])).alias("least"),
                ),
            )

        return F.aggregate(all_, start, slid, lambda state: F.lit(math.log2(WINDOW)) - state["least"] / WINDOW)

    return _let(numbers, over)


def looks_random(string: Column) -> Column:
    """Whether the entropy of a candidate, or of a part of it between allowed words, reaches its class's threshold."""

    def part_looks_random(part: Column) -> Column:
        least = F.lit(CLASSES[-1][1])
        for form, threshold in reversed(CLASSES[:-1]):
            least = F.when(part.rlike(form), threshold).otherwise(least)
        formed = (F.length(part) >= WINDOW) & part.rlike("[0-9]") & part.rlike("[A-Za-z]")
        return F.when(formed, F.round(greatest_entropy(part), 9) >= least).otherwise(False)

    formed = string.rlike("[0-9]") & string.rlike("[A-Za-z]") & ~string.rlike(ALLOWED)
    return F.when(formed, F.exists(F.split(string, ALLOWED_WORDS, -1), part_looks_random)).otherwise(False)


def secret_spans(text: Column) -> Column:
    """Sorted spans (begin, kind, end) of a text; kind is the place in KINDS. A null text has none.

    Cheap tests that no match can fail come first, so that most texts are never
    searched for positions.
    """
    none = F.array().cast("array<struct<begin:bigint,kind:int,end:bigint>>")
    lowered = F.lower(text)
    named = F.lit(False)
    for name in NAMES:
        named = named | lowered.contains(name)
    gates = (named, text.contains("AKIA"), text.rlike(HEX), text.rlike(CANDIDATE))
    found = (
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["found"]) >= VALUE_CHARS),
        matches(text, ACCESS),
        matches(text, HEX),
        F.filter(matches(text, CANDIDATE), lambda m: looks_random(m["found"])),
    )

    def spans(kind: int) -> Column:
        of_kind = F.transform(
            found[kind], lambda m: F.struct(m["begin"].alias("begin"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        )
        return F.when(gates[kind], of_kind).otherwise(none)

    return F.array_sort(F.concat(*(spans(kind) for kind in range(len(KINDS)))))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["begin"], s["end"])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans; one row for each input row.

    base_sha256 digests the spans of the known forms, spans lists all of them,
    each as kind:begin:end in the order of begin and kind, joined by commas. A
    null or empty text has none of either. Other columns are ignored.
    """
    rows = docs.select("doc_id", secret_spans(F.coalesce("text", F.lit(""))).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] < KINDS.index("entropy"))
    return rows.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by MASK, and n_chars brought up to date where it changed.

    Spans that overlap are masked as one. Texts without secrets, null ones among them,
    and all other columns stay as they are.
    """
    rows = docs.withColumn("__found", secret_spans(F.coalesce("text", F.lit(""))))

    def masked(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

        def one(state: Column, span: Column) -> Column:
            gap = F.substr(F.col("text"), (state["at"] + 1).cast("int"), (span["begin"] - state["at"]).cast("int"))
            parts = F.when(span["begin"] < state["at"], state["parts"]).otherwise(
                F.concat(state["parts"], F.array(gap, F.lit(MASK)))
            )
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

        tail = lambda state: F.substr(F.col("text"), (state["at"] + 1).cast("int"))
        return F.aggregate(spans, start, one, lambda state: F.concat(F.concat_ws("", state["parts"]), tail(state)))

    any_ = F.size("__found") > 0
    rows = rows.withColumn("__masked", F.when(any_, masked(F.col("__found"))).otherwise(F.col("text")))
    changed = {"text": F.col("__masked")}
    if "n_chars" in docs.columns:
        length = F.length("__masked").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(any_, length).otherwise(F.col("n_chars"))
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
