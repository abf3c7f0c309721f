"""Secret scanning: fixed patterns, and the Shannon entropy of sliding windows over candidate strings.

Everything is DataFrame expressions, evaluated row by row without a shuffle. A candidate is a run of
at least MIN_LENGTH key characters with a letter and a digit. It belongs to the narrowest character
class that holds all of it; the class gives the window and the entropy from which it is reported. The
entropy of the next window comes from the counts of the one character that leaves and the one that
enters: with S = sum of c * log2(c) over the window's counts, H = log2(w) - S / w. Windows that overlap
a match of the allow list do not count; matches of the fixed patterns are never suppressed. Counts are packed
into a few words that go from window to window, so a candidate takes time in proportion to its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import located, rewritten

#: The patterns of the three base kinds, and the least length of what is reported.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

MIN_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character class, window, bits of entropy.
CLASSES = ((r"^[0-9a-fA-F]+$", 20, 3.0), (r"^[A-Z0-9]+$", 20, 3.4), (r"^[A-Za-z0-9]+$", 20, 3.6), (r"", 20, 3.8))
#: Documentation keys, runs of the alphabet, repeated characters, UUIDs.
ALLOW = r"(?i)example|placeholder|changeme|0123456789|abcdefghij|(.)\1{5,}|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


#: Key characters lie within ASCII 43 to 122; a count takes 8 bits, so 10 words of 64 bits hold all counts of a window.
_LOWEST, _WORDS, _MOST = 43, 10, 255
#: c * log2(c) of each count, as whole numbers of 2**-32: sums of them never drift, however long the string.
_SCALE = 1 << 32
_TERMS = [0, *[round(c * math.log2(c) * _SCALE) for c in range(1, _MOST + 1)]]


def peak_entropy(s: Column, window: int) -> Column:
    """The highest entropy of any window of s, in bits a character; the whole of s if it is shorter.

    s holds key characters only (those of CANDIDATE). Time is in proportion to its length: the counts of the window are the state.
    """
    if window > _MOST:
        raise ValueError(f"windows have at most {_MOST} characters")
    terms = F.array(*[F.lit(t).cast("long") for t in _TERMS])
    shift = lambda c: F.pmod(c, F.lit(8)) * 8
    count = lambda counts, c: F.call_function("shiftrightunsigned", F.element_at(counts, F.shiftright(c, 3) + 1), shift(c)).bitwiseAND(F.lit(_MOST)).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))

    def over(chars):
        size = F.size(chars)

        def step(state, i):
            came, went = F.element_at(chars, i), F.element_at(chars, F.greatest(i - window, F.lit(1)))
            full = i > window
            n_out, n_in = count(state["counts"], went), count(state["counts"], came)
            n_in = n_in - F.when(full & (came == went), 1).otherwise(0)
            # The character that left, then the one that came: their counts and terms are all that changes.
            lost = F.when(full, F.element_at(terms, n_out + 1) - F.element_at(terms, n_out)).otherwise(F.lit(0).cast("long"))
            total = state["s"] - lost + F.element_at(terms, n_in + 2) - F.element_at(terms, n_in + 1)
            out_word, in_word = F.when(full, F.shiftright(went, 3)).otherwise(-1), F.shiftright(came, 3)
            counts = F.transform(state["counts"], lambda x, j: x - F.when(j == out_word, one(went)).otherwise(F.lit(0).cast("long")) + F.when(j == in_word, one(came)).otherwise(F.lit(0).cast("long")))
            low = F.when(i >= F.least(F.lit(window), size), F.least(state["low"], total)).otherwise(state["low"])
            return F.struct(counts.alias("counts"), total.alias("s"), low.alias("low"))

        zero = F.struct(F.array(*[F.lit(0).cast("long")] * _WORDS).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(2**62).cast("long").alias("low"))
        w = F.least(F.lit(window), size)
        return F.when(size > 0, F.log2(w.cast("double")) - F.aggregate(F.sequence(F.lit(1), size), zero, step)["low"] / w / float(_SCALE)).otherwise(F.lit(0.0))

    # The characters are taken apart once, and bound by the lambda: they are not computed again at each step.
    chars = F.transform(F.split(s, ""), lambda c: F.ascii(c) - _LOWEST)
    return F.element_at(F.transform(F.array(chars), over), 1)


def _suspicious(s: Column) -> Column:
    verdict, pieces = F.lit(False), F.filter(F.split(s, ALLOW), lambda x: F.char_length(x) >= MIN_LENGTH)
    for pattern, window, bits in reversed(CLASSES):
        ok = F.exists(pieces, lambda x: peak_entropy(x, window) >= bits)  # noqa: B023
        verdict = ok if not pattern else F.when(s.rlike(pattern), ok).otherwise(verdict)
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), verdict).otherwise(False)


def secret_spans(text: Column) -> Column:
    """array<struct<start, rank, end>> sorted by start, then kind in the order of KINDS; offsets in code points."""
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.char_length(x["g1"]) >= ASSIGN_LEAST)
    found = [assign, located(text, ACCESS), located(text, HEX), F.filter(located(text, CANDIDATE), lambda x: _suspicious(x["m"]))]
    tag = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"))
    tagged = [F.transform(a, tag(k)) for k, a in enumerate(found)]
    return F.array_sort(F.concat(*tagged))


def spans_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """docs with a column out_col: all secrets of the whole text, see secret_spans.

    A null or empty text has none (an empty array). Repeated rows are scanned alike, all other columns
    stay as they are; out_col replaces a column of that name. Overlapping spans of different kinds are
    all listed; spans of one kind never overlap.
    """
    return docs.withColumn(out_col, secret_spans(F.coalesce(F.col(text_col), F.lit(""))))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col replaced by mark; null texts stay null. Columns are those of docs."""
    names = docs.columns
    found = scan_secrets(docs, text_col, "__spans")
    return found.withColumn(text_col, rewritten(F.col(text_col), F.col("__spans"), lambda x: F.lit(mark))).select(*names)
