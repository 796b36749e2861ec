"""Secret scans: fixed forms, and entropy of sliding windows.

Fixed forms are assignments to telling names, access keys and long hexadecimal runs. Beyond them, candidate
strings (runs of key characters) are read by a sliding window. The counts of the window's characters
are kept up to date by one addition and one removal a step, and with them the sum of c * log2(c) that the
Shannon entropy needs; counts of digits, letters of either case and non-hexadecimal characters tell the class of
the window, and each class has its own bound. Candidates that an allow-list pattern describes (plain words, numbers,
UUIDs, joined names, rulers) are passed over. Row-local, built-in functions only, no shuffle.

Positions are code points, ends are exclusive. Defined results: null and empty texts have no spans; null ids and
repeated rows are kept as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import bound

# fixed forms of the scan, in the order in which kinds are listed
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "struct<start:int,kind:int,stop:int>"
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
# what is harmless as a whole, and what is harmless if every stretch between joining marks looks like it
ALLOWED = (r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",)
ALLOWED_PARTS = (r"[A-Za-z]?[a-z]*[0-9]{0,4}", r"[A-Z]*[0-9]{0,4}", r"v?[0-9]*")
_JOINTS = "[-+/_=]+"


@dataclass(frozen=True)
class EntropyRule:
    """Window length, bits a character in each class, and the allow-list.

    Patterns are best kept free of repeated groups, for which the regular expressions of the JVM recurse.
    """

    window: int = 20
    hex_bits: float = 2.9
    mixed_bits: float = 3.6
    allowed: Sequence[str] = field(default=ALLOWED)
    allowed_parts: Sequence[str] = field(default=ALLOWED_PARTS)

    def harmless(self, candidate: Column) -> Column:
        parts = F.forall(F.split(candidate, _JOINTS), lambda part: part.rlike(_whole(self.allowed_parts)))
        return candidate.rlike(_whole(self.allowed)) | parts


def _whole(patterns: Sequence[str]) -> str:
    return "^(?:" + "|".join(patterns) + ")$"


def _form_spans(text: Column, pattern: str, kind: int, matches: Column, good: Column | None) -> Column:
    """Spans of a form's matches. Gaps and matches alternate, so their lengths add up to positions."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(gaps, state, i):
        begin = state["at"] + F.length(F.get(gaps, i))
        stop = begin + F.length(F.get(matches, i))
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        kept = F.concat(state["spans"], span)
        if good is not None:
            kept = F.when(F.length(F.get(good, i)) >= 8, kept).otherwise(state["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    found = bound(
        F.split(text, pattern, -1),
        lambda gaps: F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, lambda state, i: step(gaps, state, i), lambda s: s["spans"]),
    )
    return F.when(F.size(matches) > 0, found).otherwise(start["spans"])


def _xlogx(count: Column) -> Column:
    return count * F.log2(F.greatest(count, F.lit(1)).cast("double"))


def _moved(state: Column, code: Column, by: int) -> tuple[Column, Column]:
    """Counts after one character came or went, and how much the sum of c * log2(c) changed."""
    old = F.get(state, code - 1)
    new = F.concat(F.slice(state, F.lit(1), code - 1), F.array(old + by), F.slice(state, code + 1, F.lit(len(_ALPHABET))))
    return new, _xlogx(old + by) - _xlogx(old)


def window_spans(candidate: Column, rule: EntropyRule) -> Column:
    """Joined ranges (start, stop) of the windows of one candidate whose entropy is over the bound of their class."""
    w = rule.window
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("upper"),
        F.lit(0).alias("lower"), F.lit(0).alias("beyond_hex"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("last"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("spans"),
    )
    kinds = {
        "digits": lambda k: (k <= 10), "upper": lambda k: (k > 10) & (k <= 36), "lower": lambda k: (k > 36) & (k <= 62),
        "beyond_hex": lambda k: ~((k <= 16) | ((k > 36) & (k <= 42))),
    }

    def step(state, code):
        full = state["n"] >= w
        oldest = F.get(state["last"], F.lit(0))
        added, gain = _moved(state["counts"], code, 1)
        taken, loss = _moved(added, oldest, -1)
        counts = F.when(full, taken).otherwise(added)
        total = state["sum"] + gain + F.when(full, loss).otherwise(0.0)
        tallies = {
            name: state[name] + test(code).cast("int") - F.when(full, test(oldest).cast("int")).otherwise(0) for name, test in kinds.items()
        }
        recent = F.concat(F.when(full, F.slice(state["last"], 2, w)).otherwise(state["last"]), F.array(code))
        n = state["n"] + 1
        bits = F.lit(math.log2(w)) - total / w
        is_hex = tallies["beyond_hex"] == 0
        hexadecimal = is_hex & (bits >= rule.hex_bits) & (tallies["digits"] >= 3) & (tallies["digits"] <= w - 3)
        mixed = ~is_hex & (bits >= rule.mixed_bits) & (tallies["digits"] >= 2) & (tallies["digits"] + 4 <= w)
        secret = (n >= w) & (hexadecimal | mixed)
        last = F.get(state["spans"], F.size(state["spans"]) - 1)
        joins = (F.size(state["spans"]) > 0) & (last["stop"] >= n - w)
        longer = F.concat(F.slice(state["spans"], F.lit(1), F.greatest(F.lit(0), F.size(state["spans"]) - 1)), F.array(F.struct(last["start"].alias("start"), n.alias("stop"))))
        fresh = F.concat(state["spans"], F.array(F.struct((n - w).alias("start"), n.alias("stop"))))
        spans = F.when(secret & joins, longer).when(secret, fresh).otherwise(state["spans"])
        return F.struct(
            counts.alias("counts"), total.alias("sum"), *(tallies[k].cast("int").alias(k) for k in kinds), n.alias("n"), recent.alias("last"), spans.alias("spans")
        )

    return F.aggregate(codes, zero, step, lambda s: s["spans"])


def _entropy_spans(text: Column, matches: Column, rule: EntropyRule) -> Column:
    """Spans of secret windows in the candidates that no allow-list pattern describes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(gaps, state, i):
        begin = state["at"] + F.length(F.get(gaps, i))
        text_of = F.get(matches, i)
        found = F.transform(
            window_spans(text_of, rule),
            lambda s: F.struct((begin + s["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (begin + s["stop"]).alias("stop")),
        )
        kept = F.when(rule.harmless(text_of), state["spans"]).otherwise(F.concat(state["spans"], found))
        return F.struct((begin + F.length(text_of)).alias("at"), kept.alias("spans"))

    found = bound(
        F.split(text, _CANDIDATE % rule.window, -1),
        lambda gaps: F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, lambda state, i: step(gaps, state, i), lambda s: s["spans"]),
    )
    # most candidates are words: nothing is read further unless one of them is not allowed
    odd = F.exists(matches, lambda m: ~rule.harmless(m))
    return F.when(odd, found).otherwise(start["spans"])


def secret_spans(docs: DataFrame, *, text_col: str = "text", rule: EntropyRule = EntropyRule(), out: str = "secret_spans") -> DataFrame:
    """Every row with an array of (start, kind, stop), by start and kind; kind counts along `KINDS`.

    Entropy adds spans: those that lie within a span of a fixed form are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    matched = docs.select(
        *kept,
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("__assign"),
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("__value"),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("__access"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("__hex"),
        F.regexp_extract_all(text, F.lit(_CANDIDATE % rule.window), F.lit(0)).alias("__candidate"),
    )
    found = matched.select(
        *kept,
        F.concat(
            _form_spans(text, ASSIGN, 0, F.col("__assign"), F.col("__value")),
            _form_spans(text, ACCESS, 1, F.col("__access"), None),
            _form_spans(text, HEX, 2, F.col("__hex"), None),
        ).alias("__base"),
        _entropy_spans(text, F.col("__candidate"), rule).alias("__entropy"),
    )
    new = F.filter("__entropy", lambda s: ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return found.select(*kept, F.array_sort(F.concat("__base", new)).alias(out))


def describe(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def digest(found: DataFrame, spans_col: str = "secret_spans") -> DataFrame:
    spans = F.col(spans_col)
    kinds = F.transform(spans, lambda s: s["kind"])
    of = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in range(len(KINDS))]
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of[0].alias("n_assign"), of[1].alias("n_access"), of[2].alias("n_hex"), F.sha2(describe(base), 256).alias("base_sha256"),
        describe(spans).alias("spans"), of[3].alias("n_entropy"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Every row with its secret spans masked; overlapping spans share one mask. Null texts stay null."""
    found = secret_spans(docs, text_col=text_col, rule=rule, out="__spans")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state, s):
        apart = s["start"] >= state["at"]
        before = F.substr(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        covers = (~apart) & (state["at"] > 0)
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(covers, state["text"]).otherwise(F.concat(state["text"], before, F.lit(mask))).alias("text"))

    masked = F.aggregate("__spans", start, step, lambda s: F.concat(s["text"], F.substr(text, s["at"] + 1)))
    columns = [F.when(F.size("__spans") > 0, masked).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns)
