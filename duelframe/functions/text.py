"""String keys and labels as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe import fixed_values as fv

# whitespace as str.split()/str.strip() understand it; a character class of all these is slow to match
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
_ASCII_ONLY = r"^[\x00-\x7F]*$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(col(value), F.lit(_SPACES))


def collapse_spaces(value: Column | str) -> Column:
    spaced = F.translate(col(value), _SPACES, " " * len(_SPACES))
    return F.btrim(F.regexp_replace(spaced, " {2,}", " "))


def is_blank(value: Column | str) -> Column:
    """True for null and for text of whitespace only."""
    return F.coalesce(F.length(strip(value)) == 0, F.lit(True))


def blank_to_null(value: Column | str) -> Column:
    stripped = strip(value)
    return F.when(F.length(stripped) > 0, stripped)


@F.pandas_udf(T.StringType())
def _fold_accents(values: pd.Series) -> pd.Series:
    """Decompose, drop combining marks and case-fold; only non-ASCII rows get here."""

    def fold(text):
        if text is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return plain.casefold()

    return values.map(fold)


@F.pandas_udf(T.StringType())
def _fold_case(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else text.casefold())


def _folded(value: Column, fold, ascii_only: bool) -> Column:
    if ascii_only:
        return F.lower(value)
    plain = value.rlike(_ASCII_ONLY)
    # ASCII rows send a null to Python, so only accented text crosses the boundary
    return F.when(plain, F.lower(value)).otherwise(fold(F.when(~plain, value)))


def folded_case(value: Column | str, *, ascii_only: bool = False) -> Column:
    """Case-folded text; only rows beyond ASCII leave the JVM, and none where all texts are known to be ASCII."""
    return _folded(col(value), _fold_case, ascii_only)


def name_key(value: Column | str, *, ascii_only: bool = False) -> Column:
    """Accent- and case-insensitive name key: runs of other characters become one space."""
    folded = _folded(col(value), _fold_accents, ascii_only)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def simple_name_key(value: Column | str, *, ascii_only: bool = False) -> Column:
    """Case-folded name with whitespace collapsed; punctuation stays."""
    return collapse_spaces(_folded(col(value), _fold_case, ascii_only))


def id_key(value: Column | str) -> Column:
    """Stable id from an id or a URL ending in one; null when nothing is left."""
    cleaned = F.regexp_replace(strip(value), "/+$", "")
    last = F.regexp_extract(cleaned, "[^/]*$", 0)
    last = F.when(last.rlike(fv.STABLE_ID_PATTERN), F.lower(last)).otherwise(last)
    return F.when(F.length(last) > 0, last)


#: all characters beyond ASCII whose case-folded form is ASCII
FOLDED_TO_ASCII = {
    "\u00df": "ss", "\u017f": "s", "\u1e9e": "ss", "\u212a": "k", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
    "\ufb05": "st", "\ufb06": "st",
}


def folded_to_ascii(value: Column) -> Column:
    """Case-folded text without Python, as far as it can equal an ASCII text: what folds to other characters may differ."""
    replaced = value
    for letter, folded in FOLDED_TO_ASCII.items():
        replaced = F.replace(replaced, F.lit(letter), F.lit(folded))
    return F.lower(F.when(value.rlike(_ASCII_ONLY), value).otherwise(replaced))


def class_label(value: Column | str, *, ascii_only: bool = False, for_lookup: bool = False) -> Column:
    """Cleaned context-class label, noise words removed in their fixed order.

    With `for_lookup`, the label is only compared with ASCII texts, and no row goes through Python.
    """
    spaced = F.replace(strip(value), F.lit("_"), F.lit(" "))
    folded = folded_to_ascii(spaced) if for_lookup and not ascii_only else _folded(spaced, _fold_case, ascii_only)
    label = F.replace(folded, F.lit("'"), F.lit(""))
    for noise in fv.CLASS_LABEL_NOISE:
        label = F.replace(label, F.lit(noise), F.lit(" "))
    return collapse_spaces(label)


def parse_bool(value: Column | str) -> Column:
    """1/true/yes and 0/false/no, trimmed, any case; null for anything else."""
    word = F.lower(strip(col(value).cast("string")))
    return F.when(word.isin(*fv.TRUE_WORDS), F.lit(True)).when(word.isin(*fv.FALSE_WORDS), F.lit(False))


def quoted(value: Column) -> Column:
    """Text in quotes: single ones, or double ones where it holds a single and no double one."""
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    doubled = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(doubled, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def filled(template: str, *values: Column) -> Column:
    """A message with its gaps filled in; null if a value is null."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def sql_text(value: str) -> str:
    """Text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    """Texts or numbers as a SQL array literal."""
    parts = [sql_text(v) if isinstance(v, str) else f"{float(v)!r}D" for v in values]
    return f"array({', '.join(parts)})"


def sql_map(pairs: dict[str, str]) -> str:
    """Small fixed text-to-text table as a SQL map; the optimizer folds it to a constant."""
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items()) + ")"


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a fixed text table, null when the key is null or absent."""
    return F.try_element_at(F.expr(sql_map(pairs)), F.coalesce(key, F.lit("\u0000")))


def display_label(value: Column | str, kind: str, *, fallback: str = fv.LABEL_FALLBACK) -> Column:
    """Display label of a code; unknown codes are humanised."""
    if kind not in fv.LABELS:
        raise ValueError(f"unknown label kind {kind!r}")
    merged: dict[str, str] = {}
    for other in fv.LABEL_MERGE_ORDER:
        merged.update(fv.LABELS[other])
    merged.update(fv.LABELS[kind])
    raw = strip(col(value).cast("string"))
    key = F.regexp_replace(F.upper(raw), "[ -]+", "_")
    human = _capitalise_words(F.regexp_replace(raw, "[_-]+", " "))
    if kind == "weight_class":
        suffix = r"(?i)\s+bout$"
        human = F.when(raw.rlike(suffix), F.regexp_replace(raw, suffix, "")).otherwise(human)
    return F.when(is_blank(raw), F.lit(fallback)).otherwise(F.coalesce(lookup(merged, key), human))


def _capitalise_words(value: Column) -> Column:
    """Upper-case the first ASCII word character of every run of word characters."""
    pieces = F.regexp_extract_all(value, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    raised = F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    word = r"^[A-Za-z0-9_]"
    kept = F.zip_with(pieces, raised, lambda w, up: F.when(w.rlike(word), up).otherwise(w))
    return F.array_join(kept, "")
