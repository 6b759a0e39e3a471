"""Raw full-text search: phrases, prefixes, AND, OR, NOT and brackets over whole texts.

``apache licen*`` asks for both, ``"the version"`` for words in a row, ``a NOT b`` for what has the first and lacks the
second.  NOT binds closer than AND, and AND closer than OR; operators are in upper case.  Every quoted or bare piece is
an atom; an answer is ranked by the occurrences of all atoms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.graph import keep
from stratalog.operators.search import K1, LEAST_IDF, B, n_words, plain, spaced


@dataclass(frozen=True)
class Atom:
    words: tuple[str, ...]
    prefix: bool = False


def parse(raw: str) -> tuple:
    """Nested ("and" | "or" | "not", left, right) over atoms; ValueError where the syntax is wrong."""
    tokens = re.findall(r'"((?:[^"]|"")*)"(\*?)|([()])|([^\s()"*]+)(\*?)', raw)
    if re.sub(r'"(?:[^"]|"")*"\*?|[()]|[^\s()"*]+\*?|\s', "", raw):
        raise ValueError(f"not a search: {raw}")
    items: list = []
    for quoted, star, bracket, word, word_star in tokens:
        if bracket or word in ("AND", "OR", "NOT"):
            items.append(bracket or word)
        elif found := tuple(re.findall(r"[^\W_]+", plain(quoted or word))):
            items.append(Atom(found, bool(star or word_star)))

    def binary(names: tuple, inner, implied: bool = False):
        def read(at: int) -> tuple:
            left, at = inner(at)
            while at < len(items) and (items[at] in names or (implied and (isinstance(items[at], Atom) or items[at] == "("))):
                name = items[at] if items[at] in names else "AND"
                right, at = inner(at + (items[at] in names))
                left = (name.lower(), left, right)
            return left, at

        return read

    def primary(at: int) -> tuple:
        if at < len(items) and isinstance(items[at], Atom):
            return items[at], at + 1
        if at < len(items) and items[at] == "(":
            inside, at = whole(at + 1)
            if at < len(items) and items[at] == ")":
                return inside, at + 1
        raise ValueError(f"not a search: {raw}")

    whole = binary(("OR",), binary(("AND",), binary(("NOT",), primary), implied=True))
    tree, end = whole(0)
    if end != len(items):
        raise ValueError(f"not a search: {raw}")
    return tree


def atoms(tree) -> list[Atom]:
    """Each atom once, in reading order."""
    return [tree] if isinstance(tree, Atom) else list(dict.fromkeys(a for part in tree[1:] for a in atoms(part)))


def counted(docs: DataFrame, asked: dict[Atom, str]) -> DataFrame:
    """(id, length and a count under each atom's name) of documents (id, text).

    A text becomes its words with single spaces around them.  An atom is met at a space that its words follow, and only
    that space is taken, so occurrences may overlap; each is one search through the text.
    """
    follows = {n: F.lit(f" (?={' '.join(a.words)}{'' if a.prefix else ' '})") for a, n in asked.items()}
    words = docs.select("id", spaced(F.col("text")).alias("words_"))
    return words.select("id", n_words(F.col("words_")).alias("length"), *[F.regexp_count("words_", p).alias(n) for n, p in follows.items()])


def holds(tree, found: dict[Atom, Column]) -> Column:
    if isinstance(tree, Atom):
        return found[tree] > 0
    left, right = (holds(part, found) for part in tree[1:])
    return {"and": left & right, "or": left | right, "not": left & ~right}[tree[0]]


def match(docs: DataFrame, raw: str) -> DataFrame:
    """(id, score) of documents (id, text) that the search finds; a higher score is better.

    Texts are read once and shuffled never: what is kept of a document is its length and a count for each atom.  Counts of
    documents are one row.
    """
    tree = parse(raw)
    names = {a: f"f{k}" for k, a in enumerate(atoms(tree))}
    by_id = keep(counted(docs, names))
    stats = by_id.agg(F.count("*").alias("all"), F.avg("length").alias("mean"), *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names.values()])
    scores = []
    for n in names.values():
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("all") - F.col(f"n_{n}") + 0.5) / (F.col(f"n_{n}") + 0.5)))
        scores.append(idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    hit = by_id.where(holds(tree, {a: F.col(n) for a, n in names.items()}))
    return hit.crossJoin(F.broadcast(stats)).select("id", F.round(reduce(lambda x, y: x + y, scores), 6).alias("score"))


def match_sql(table: str, raw: str) -> str:
    """The same as a SQL sub-select with columns id and score over ``table`` (id, text)."""
    tree = parse(raw)
    names = {a: f"f{k}" for k, a in enumerate(atoms(tree))}

    def count(a: Atom) -> str:
        tests = [f"starts_with(w[i + {k}], '{x}')" if a.prefix and k == len(a.words) - 1 else f"w[i + {k}] = '{x}'" for k, x in enumerate(a.words)]
        return f"len(list_filter(range(1, len(w) + 1), lambda i: coalesce({' AND '.join(tests)}, false)))"

    def test(t) -> str:
        return f"{names[t]} > 0" if isinstance(t, Atom) else f"({test(t[1])} {'AND NOT' if t[0] == 'not' else t[0].upper()} {test(t[2])})"

    score = " + ".join(f"greatest({LEAST_IDF}, ln((n_all - n_{n} + 0.5) / (n_{n} + 0.5))) * {n} * {K1 + 1} / ({n} + {K1} * ({1 - B} + {B} * len(w) / mean))" for n in names.values())
    return f"""(WITH words AS (SELECT id, [w FOR w IN regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+') IF w <> ''] AS w FROM {table}),
found AS (SELECT id, w, {", ".join(f"{count(a)} AS {n}" for a, n in names.items())} FROM words),
stats AS (SELECT count(*) AS n_all, avg(len(w)) AS mean, {", ".join(f"count(*) FILTER ({n} > 0) AS n_{n}" for n in names.values())} FROM found)
SELECT id, round({score}, 6) AS score FROM found, stats WHERE {test(tree)})"""
