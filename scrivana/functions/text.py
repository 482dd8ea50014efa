"""Normalisation and error rates of transcripts, as column functions.

White space is the Unicode set (including U+001C-U+001F and U+0085); lines end at LF only, so patterns carry the
flags ``(?md)``. Steps run in one fixed order; a policy says which of them run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from scrivana.functions.edits import distances

# White space, dashes and quotes that count as the same character.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
DASHES = "–—‒―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"

@dataclass(frozen=True)
class NormalisationPolicy:
    unicode_form: str = "NFKC"
    fold_dashes: bool = True
    fold_quotes: bool = True
    strip_markdown: bool = True
    collapse_whitespace: bool = True
    fold_case: bool = False


def _beyond_ascii(text: Column, change: Callable[[Column], Column], plain: Column) -> Column:
    """``plain`` where the text is ASCII, else what a Python function makes of it; ASCII texts go to Python as nulls."""
    ascii_ = F.length(text) == F.octet_length(text)
    return F.when(ascii_, plain).otherwise(change(F.when(~ascii_, text)))


def unicode_form(text: Column, form: str) -> Column:
    """A Unicode normal form. ASCII texts, which no form changes, stay in the JVM."""

    @pandas_udf("string")
    def change(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return _beyond_ascii(text, change, text)


def casefold(text: Column) -> Column:
    @pandas_udf("string")
    def change(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None else x.casefold())

    return _beyond_ascii(text, change, F.lower(text))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def fold_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def strip_markdown(text: Column) -> Column:
    """Separator rows become a space, heading marks and emphasis go, pipes become spaces."""
    inner = SPACE[1:-1]
    text = F.regexp_replace(text, rf"(?md)^{SPACE}*\|?[{inner}:\-|]+\|?{SPACE}*$", " ")
    text = F.regexp_replace(text, rf"(?md)^{SPACE}{{0,3}}#{{1,6}}{SPACE}+", "")
    return F.translate(F.regexp_replace(text, r"\*{1,3}|_{1,3}|`+", ""), "|", " ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """Nothing but white space of any kind; null counts as nothing."""
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE[1:-1]}]"))


def normalise(text: Column, policy: NormalisationPolicy = NormalisationPolicy()) -> Column:
    text = unicode_form(text, policy.unicode_form)
    for wanted, step in ((policy.fold_dashes, fold_dashes), (policy.fold_quotes, fold_quotes), (policy.strip_markdown, strip_markdown), (policy.collapse_whitespace, collapse_whitespace), (policy.fold_case, casefold)):
        text = step(text) if wanted else text
    return text


def normalised(text: str, policy: NormalisationPolicy) -> str:
    """``normalise`` for one text inside a Python function. Python's white space is that of SPACE."""
    out = unicodedata.normalize(policy.unicode_form, text)
    if not out.isascii():
        for wanted, characters, plain in ((policy.fold_dashes, DASHES, "-"), (policy.fold_quotes, SINGLE_QUOTES, "'"), (policy.fold_quotes, DOUBLE_QUOTES, '"')):
            for c in characters if wanted else "":
                out = out.replace(c, plain)
    if policy.strip_markdown:
        if not policy.collapse_whitespace:
            out = _SEPARATORS.sub(" ", out)
        elif any(c in out for c in ":-|"):  # white space beside a separator row goes anyway
            out = "\n".join(" " if _is_separator(line) else line for line in out.split("\n"))
        if "#" in out:
            out = _HEADINGS.sub("", out)
        for c in "*_`":
            out = out.replace(c, "")
        out = out.replace("|", " ")
    if policy.collapse_whitespace:
        out = " ".join(out.split())
    return out.casefold() if policy.fold_case else out


#: A line of a separator row among texts joined by NUL.
_JOINED_SEPARATOR = re.compile(r"(?<![^\0\n])[^\S\n]*[:\-|](?:[^\S\n]|[:\-|])*(?![^\0\n])")


def normalised_all(texts: list[str], policy: NormalisationPolicy) -> list[str]:
    """``normalised`` for many short texts in a few calls: joined by NUL, with which no form composes. Texts with headings or
    separator rows, which are told by their lines, go one by one."""
    joined = "\0".join(texts)
    whole = unicodedata.normalize(policy.unicode_form, joined)
    if not policy.collapse_whitespace or not texts or not joined.count("\0") == whole.count("\0") == len(texts) - 1:
        return [normalised(t, policy) for t in texts]
    if not whole.isascii():
        for wanted, characters, plain in ((policy.fold_dashes, DASHES, "-"), (policy.fold_quotes, SINGLE_QUOTES, "'"), (policy.fold_quotes, DOUBLE_QUOTES, '"')):
            for c in characters if wanted else "":
                whole = whole.replace(c, plain)
    alone: list[int] = []
    if policy.strip_markdown:
        if "#" in whole or _JOINED_SEPARATOR.search(whole):
            alone = [k for k, t in enumerate(whole.split("\0")) if "#" in t or _JOINED_SEPARATOR.search(t)]
        for c in "*_`":
            whole = whole.replace(c, "")
        whole = whole.replace("|", " ")
    out = [" ".join(t.split()) for t in whole.split("\0")]
    out = [t.casefold() for t in out] if policy.fold_case else out
    for k in alone:
        out[k] = normalised(texts[k], policy)
    return out


_SEPARATORS, _HEADINGS = re.compile(r"(?m)^\s*\|?[\s:\-|]+\|?\s*$"), re.compile(r"(?m)^\s{0,3}#{1,6}\s+")


def _is_separator(line: str) -> bool:
    return not line[:1].isalnum() and not line.replace(":", "").replace("-", "").replace("|", "").strip()


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _rate(distance: Column, size: Column, nothing: Column) -> Column:
    """Errors over reference size, uncapped; against an empty reference 0 for an empty prediction, else 1."""
    return F.when(size > 0, distance.cast("double") / size).otherwise(F.when(nothing, 0.0).otherwise(1.0))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def character_error_rate(reference: Column, prediction: Column) -> Column:
    return _rate(edit_distance(reference, prediction), F.length(reference), F.length(prediction) == 0)


@arrow_udf(IntegerType())
def word_distance(reference: pa.Array, prediction: pa.Array) -> pa.Array:
    """Levenshtein distance in words, of texts of any length."""
    pairs = [(a.as_py(), b.as_py()) for a, b in zip(reference, prediction)]
    found = iter(distances([(a.split(), b.split()) for a, b in pairs if a is not None and b is not None]))
    return pa.array([None if a is None or b is None else next(found) for a, b in pairs], pa.int32())


def word_error_rate(reference: Column, prediction: Column) -> Column:
    return _rate(word_distance(reference, prediction), F.size(words(reference)), F.size(words(prediction)) == 0)


NORMAL_DISTANCES = ("normalised", "words", "reference_chars", "prediction_chars", "reference_words", "prediction_words")
#: Words that characters can stand for.
MOST_CODES = 0x110000 - 0x800
#: Characters of texts that are compared at a time.
COMPARED_CHARS = 1 << 22


def _together(references: pa.Array, predictions: pa.Array, of_pairs: Callable[[list[tuple[str, str]]], list]) -> list:
    """What ``of_pairs`` finds for each pair, None where either text is null. Some pairs at a time, so no more than
    ``COMPARED_CHARS`` are held as strings (or one pair, if that is longer)."""
    out: list = [None] * len(references)
    held: list[int] = []
    pairs: list[tuple[str, str]] = []
    size = 0

    def settle() -> None:
        for k, found in zip(held, of_pairs(pairs)):
            out[k] = found

    for k, (a, b) in enumerate(zip(references, predictions)):
        a, b = a.as_py(), b.as_py()
        if a is None or b is None:
            continue
        if held and size + len(a) + len(b) > COMPARED_CHARS:
            settle()
            held, pairs, size = [], [], 0
        held.append(k)
        pairs.append((a, b))
        size += len(a) + len(b)
    settle()
    return out


@arrow_udf(IntegerType())
def text_distance(reference: pa.Array, prediction: pa.Array) -> pa.Array:
    """Levenshtein distance in code points, of texts of any length."""
    return pa.array(_together(reference, prediction, distances), pa.int32())


def word_codes(texts: list[str]) -> list[str] | None:
    """A string for each text of collapsed white space, in which a character stands for a word: the same one for the same
    word, in all texts. None where there are more words than characters."""
    words_ = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = words_.flatten().dictionary_encode()
    if len(coded.dictionary) > MOST_CODES:
        return None
    numbers = coded.indices.to_numpy().astype(np.uint32)
    numbers[numbers >= 0xD800] += 0x800  # no surrogates
    ends = words_.offsets.to_numpy()
    raw = numbers.tobytes()
    return ["" if not t else raw[4 * a : 4 * b].decode("utf-32-le") for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist())]


def normal_distances(reference: Column, prediction: Column, policy: NormalisationPolicy = NormalisationPolicy()) -> Column:
    """Distances of the normalised texts, in code points and in words, with their sizes; a struct of nulls where either
    text is null. The first is null, too, where normalising changes neither text: it then is ``text_distance``, which
    is a function of its own, so that whoever asks for one of both doesn't pay for the other.

    ``str.split`` knows the same white space as SPACE.
    """

    def of_pairs(pairs: list[tuple[str, str]]) -> list[tuple[int | None, ...]]:
        normal = [(normalised(a, policy), normalised(b, policy)) for a, b in pairs]
        changed = [k for k, (own, was) in enumerate(zip(normal, pairs)) if own != was]
        in_chars = dict(zip(changed, distances([normal[k] for k in changed])))
        texts = [t for pair in normal for t in pair]
        split = (policy.collapse_whitespace and word_codes(texts)) or [t.split() for t in texts]
        split = list(zip(split[::2], split[1::2]))
        in_words = distances(split)
        return [(in_chars.get(k), in_words[k], len(c), len(d), len(v), len(w)) for k, ((c, d), (v, w)) in enumerate(zip(normal, split))]

    @arrow_udf(StructType([StructField(name, IntegerType()) for name in NORMAL_DISTANCES]))
    def run(references: pa.Array, predictions: pa.Array) -> pa.Array:
        rows = [(None,) * len(NORMAL_DISTANCES) if x is None else x for x in _together(references, predictions, of_pairs)]
        columns = zip(*rows) if rows else [()] * len(NORMAL_DISTANCES)
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in columns], names=list(NORMAL_DISTANCES))

    return run(reference, prediction)


def error_rate(distance: Column, reference_size: Column, prediction_size: Column) -> Column:
    return _rate(distance, reference_size, prediction_size == 0)


def is_degenerate(reference: Column, prediction: Column, multiple: float) -> Column:
    """A prediction that ran away: not empty, and longer than ``multiple`` references (or the reference is empty)."""
    return (F.length(prediction) > 0) & ((F.length(reference) == 0) | (F.length(prediction) > F.length(reference) * F.lit(multiple)))


def strip_decoration(text: Column, glyphs: str, least: int) -> Column:
    """Without a trailing run of at least ``least`` decoration characters."""
    inner = "".join("\\" + g if not g.isalnum() else g for g in glyphs)
    bare = F.regexp_replace(text, rf"[{inner}]{{{least},}}{SPACE}*\z", "")
    return F.regexp_replace(bare, rf"{SPACE}+\z", "")


def joined_pair(label: Column, value: Column) -> Column:
    """``label: value``, one trailing colon of the label counting as the separator."""
    return F.concat(F.regexp_replace(F.rtrim(label), r":\z", ""), F.lit(": "), value)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
