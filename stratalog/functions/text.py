"""Text functions as column expressions: folding, slugs, figures, words, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded to their base, and words too common in business prose to tell subjects apart.
FOLD_FROM, FOLD_TO = "čćžšđ", "cczsd"
STOP_WORDS = (
    "i", "ili", "je", "su", "se", "na", "u", "za", "od", "do", "sa", "s", "po", "kod", "pri",
    "koji", "koja", "koje", "kojih", "sto", "kada", "ako", "te", "a", "ali", "da", "ne", "nije",
    "moze", "mora", "treba", "biti", "bude", "svaki", "svaka", "sve", "ovaj", "ova", "ovo", "the",
)
FIGURE = r"([0-9][0-9.,]*)\s*(%|posto|dana|dan|mjeseci|mjesec|sati|sat|eur|€)?"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))


def normalise(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_quote(c: Column) -> Column:
    """Folded, squeezed, without punctuation at either end."""
    return F.regexp_replace(normalise(fold(c)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def canonical_number(raw: Column) -> Column:
    """``.`` before exactly three digits groups thousands and ``,`` marks decimals; two decimals at most."""
    plain = F.replace(F.regexp_replace(raw, r"\.([0-9]{3})(?![0-9])", "$1"), F.lit(","), F.lit("."))
    fixed = F.format_string("%.2f", plain.try_cast("double"))
    return F.coalesce(F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ""), raw)


def unit(c: Column) -> Column:
    """One spelling for each unit."""
    return (
        F.when(c == "posto", "%").when(c == "dan", "dana").when(c == "mjesec", "mjeseci").when(c == "sat", "sati").when(c == "€", "eur").otherwise(c)
    )


def figures(statement: Column) -> Column:
    """The sorted distinct numbers of a statement with their units."""
    low = F.lower(statement)
    numbers = F.regexp_extract_all(low, F.lit(FIGURE), 1)
    units = F.regexp_extract_all(low, F.lit(FIGURE), 2)
    pairs = F.zip_with(numbers, units, lambda n, u: F.concat(canonical_number(F.regexp_replace(n, "[.,]+$", "")), unit(u)))
    return F.array_sort(F.array_distinct(pairs))


def first_figure(quote: Column) -> Column:
    low = F.lower(quote)
    return F.concat(canonical_number(F.regexp_replace(F.regexp_extract(low, FIGURE, 1), "[.,]+$", "")), unit(F.regexp_extract(low, FIGURE, 2)))


def content_words(c: Column) -> Column:
    """The set of five-letter stems of words of four letters or more that are not stop words."""
    words = F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(5)))))


def strip_instances(title: Column) -> Column:
    """A title without tokens that name one instance: ``#12``, ``INV-010`` and bare numbers."""
    return F.array_join(F.filter(F.split(title, " "), lambda w: ~w.rlike(r"^(#[0-9]+|[A-Za-z]+[-#][0-9]+|[0-9]+)$")), " ")


def overlaps(question: Column, text: Column) -> Column:
    return F.arrays_overlap(content_words(question), content_words(text))


def passage(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The bytes around a span, ``margin`` on either side; cut characters at the ends are dropped."""
    raw = F.encode(text, "utf-8")
    low = F.greatest(F.lit(0), start - margin)
    piece = F.substring(raw, low + 1, end + margin - low)
    return F.replace(F.make_valid_utf8(piece.cast("string")), F.lit("\ufffd"), F.lit(""))


def hits(flat: Column, quote: Column) -> Column:
    """Non-overlapping occurrences of a quote in text, both with white space collapsed."""
    q = normalise(quote)
    return F.when(F.length(q) > 0, ((F.length(flat) - F.length(F.replace(flat, q, F.lit("")))) / F.length(q)).cast("long")).otherwise(0)


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    return F.substring(F.encode(text, "utf-8"), start + 1, end - start)
