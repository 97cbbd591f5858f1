"""Text, token and dataset functions on columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from . import vocab as v
from .urls import any_of


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.trim(text), r"\s+"), token), lambda t: t != ""))


def subject_tokens(keyword: str, aliases: tuple[str, ...] = ()) -> list[str]:
    """Distinct normalised words of a keyword and its aliases, in order."""
    words = (re.sub(r"[^\w]", "", w.lower()) for x in (keyword, *aliases) for w in x.split())
    return list(dict.fromkeys(w for w in words if w))


def subject_score(text: Column, words: list[str]) -> Column:
    """Two points for each token that the text holds as a substring."""
    return sum((F.when(F.contains(text, F.lit(w)), 2).otherwise(0) for w in words), F.lit(0))


def has_subject(text: Column, words: list[str]) -> Column:
    return any_of(text, words) if words else F.lit(False)


def preview_penalty(text: Column) -> Column:
    marks = sum((F.when(F.contains(text, F.lit(m)), 6).otherwise(0) for m in v.PREVIEW_MARKERS), F.lit(0))
    return F.when((marks > 0) & any_of(text, v.FULL_SIZE_WORDS), marks - 6).otherwise(marks)


def sentences(text: Column) -> Column:
    """Sentences of a text with its white space collapsed."""
    return F.filter(F.split(F.regexp_replace(clean(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: s != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Sliding windows of `size` characters that overlap; the last may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


_SPACES, _STOP = re.compile(r"\s+", re.ASCII), re.compile(r"(?<=[.!?])\s+", re.ASCII)


def packed(text: str | None, size: int, overlap: int) -> list[str] | None:
    """Chunks of one text, in one pass over its sentences."""
    if text is None:
        return None
    whole = _SPACES.sub(" ", text).strip(" ")
    if len(whole) <= size:
        return [whole] if whole else []
    out: list[str] = []
    held: list[str] = []
    length = 0
    for s in _STOP.split(whole):
        if held and length + 1 + len(s) > size:
            out.append(" ".join(held))
            held, length = [], 0
        if len(s) > size:
            out += [s[k : k + size] for k in range(0, len(s), size - overlap)]
        elif s:
            length += len(s) + bool(held)
            held.append(s)
    return out + [" ".join(held)] if held else out


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Greedy packing of sentences into chunks of `size` characters; longer sentences are cut into windows that overlap.

    A fold of built-in functions would copy the finished chunks for every sentence; this takes each text once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: packed(x, size, overlap))

    return run(text)


def tag_tokens(trigger: str, stem: Column, alt: Column, subject: Column) -> Column:
    """Tags of a file: the trigger, then words of its stem, of its description and the subject, distinct, in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(stem), "[0-9a-f]{8,}", ""), r"[_\-\s]+"), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    said = F.filter(F.split(F.lower(alt), r"[\s,._\-|]+"), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.filter(F.concat(F.array(F.lit(trigger)), words, said, F.array(F.lower(subject))), lambda w: w != ""))


def shape_tags(w: Column, h: Column) -> Column:
    ratio = w / h
    shape = F.when(ratio >= 1.3, "landscape").when(ratio <= 0.8, "portrait").otherwise("square")
    size = F.when((w >= 1920) | (h >= 1920), "highres").when((w <= 640) & (h <= 640), "lowres")
    return F.array_compact(F.array(shape, size))


def aesthetic(w: Column, h: Column, grey: Column, colour: Column) -> Column:
    """Score from 1 to 10 by megapixels and the deviations of grey and of colour."""
    size = F.least(F.lit(3.0), w * h / 1e6 * 1.2 + 0.5)
    parts = size + F.least(F.lit(3.5), grey / 128 * 3.5) + F.least(F.lit(3.5), colour / 128 * 3.5)
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.round(parts, 1)))


def crop_box(w: Column, h: Column, tw: int, th: int) -> Column:
    """(left, top, right, bottom) with the target's ratio: wide pictures are cut in the middle, tall ones a quarter down."""
    ratio, aim = w / h, tw / th
    cut_w, cut_h = F.floor(h * aim).cast("int"), F.floor(w / aim).cast("int")
    left = F.floor((w - cut_w) / 2).cast("int")
    top = F.floor((h - cut_h) * 0.25).cast("int")
    zero = F.lit(0)
    box = lambda a, b, c, d: F.struct(a.alias("left"), b.alias("top"), c.alias("right"), d.alias("bottom"))
    return F.when(F.abs(ratio - aim) < 0.01, box(zero, zero, w, h)).when(ratio > aim, box(left, zero, left + cut_w, h)).otherwise(box(zero, top, w, top + cut_h))


def human_size(n: Column) -> Column:
    units = ("B", "KB", "MB", "GB")
    out = F.format_string("%.2f TB", n / 1024**4)
    for i in range(len(units) - 1, -1, -1):
        out = F.when(n < 1024 ** (i + 1), F.format_string(f"%.2f {units[i]}", n / 1024**i)).otherwise(out)
    return out


def load_factor(cpu: Column, free_ram: Column) -> Column:
    return F.when((cpu >= 95) | (free_ram <= 5), 0.25).when((cpu >= 85) | (free_ram <= 15), 0.5).otherwise(1.0)
