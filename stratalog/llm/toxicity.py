"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon of whole words and word stems is learned from a bounded sample of labelled documents: terms that
toxic documents use and others do not.  The terms form a trie; a Levenshtein automaton of one or two edits
(none for short terms), the first letter included, is intersected with it and made deterministic as words arrive, so a word is read once
and most are rejected after a few letters.  A word near a term that clean documents of the sample use
nearly as often is ordinary and no hit.  Each hit is scored by the window around it: a hit inside
quotation marks or beside a reporting word counts less than one among other hits.  A logistic model over a
document's hits gives the probability.

Behaviour: null and empty texts have no hits and get the score of such a text; without labels of both classes
the score is 0; repeated rows score alike and a repeated id is one labelled document; rows without an id are
scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import held_out, map_texts
from stratalog.llm.labelled import labelled_texts

WORD = re.compile(r"\w+")
#: Labelled documents to learn from at most, half from each class.
SAMPLE_ROWS = 4000
#: A term is in this many toxic documents of the sample at least and this many times as common in them as in the
#: others, and among all prefixes that often there, chance would make fewer than this many so one-sided.
LEAST_DOCS, LEAST_RATIO, CHANCE = 6, 40.0, 0.1
SHORTEST, LONGEST = 4, 16
#: A term stands between this many different pairs of neighbours for each document (copies of one text share
#: theirs), and a prefix is lengthened while a continuation keeps this share of its documents.
LEAST_CONTEXTS, LENGTHEN = 0.5, 0.8
#: A word near a term is ordinary if this many clean documents of the sample use it at least, and toxic ones less
#: than this many times as often.
LEAST_CLEAN, LEAST_MISSPELT = 2, 4.0
#: Words on either side of a hit that make its window.
WINDOW = 8
#: What an edit takes off a hit.
MISSPELT = 0.2
#: Reporting words, fixed values: a hit beside one is likely mentioned, not used.
REPORTING = frozenset("said says saying wrote writes called calls quoted quote quotes word words term terms phrase meaning means dit mot appelle sagte wort nannte dijo palabra llama".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
OPENING, LINE = re.compile(f"[{''.join(QUOTES)}]"), re.compile(r"[^\n]+")
#: Words whose result a worker remembers.
CACHE_WORDS = 100_000


@dataclass
class Term:
    text: str
    stem: bool  # any ending may follow
    edits: int


def one_sided(n: int, others: int, part: float) -> float:
    """The chance that of n + ``others`` documents no more than ``others`` are outside a class that holds ``part`` of all."""
    whole = n + others
    return sum(math.comb(whole, k) * (1 - part) ** k * part ** (whole - k) for k in range(others + 1))


def learn_terms(texts: list[str], toxic: list[int], chance: float = CHANCE) -> list[Term]:
    """Words and stems that mark toxic documents.

    Prefixes are counted by document, and must occur among different neighbours.  The shortest prefixes that mark toxicity are kept and lengthened while
    one continuation keeps nearly all their documents; one that ends there as a whole word is a word, one with
    many endings a stem.  Prefixes of up to LONGEST letters are counted together; a longer word is followed letter by
    letter from there.
    """
    words = [set(WORD.findall(t.lower())) for t in texts]
    n1 = max(1, sum(toxic))
    n0 = max(1, len(toxic) - n1)
    in_toxic: Counter = Counter()
    for ws, y in zip(words, toxic, strict=True):
        if y:
            in_toxic.update({w[:k] for w in ws for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "$" for w in ws})
    often = {p: n for p, n in in_toxic.items() if n >= LEAST_DOCS}
    del in_toxic
    in_clean: Counter = Counter()
    for ws, y in zip(words, toxic, strict=True):
        if not y:
            in_clean.update({p for w in ws for k in range(SHORTEST, min(len(w), LONGEST) + 1) if (p := w[:k]) in often})
    marks = {
        p for p, n in often.items()
        if p[-1] != "$" and n / n1 >= LEAST_RATIO * (in_clean[p] + 0.2) / n0 and one_sided(n, in_clean[p], n1 / (n0 + n1)) * len(often) <= chance
    }
    around: dict[str, set] = {p: set() for p in marks}
    for t, y in zip(texts, toxic, strict=True):
        ws = WORD.findall(t.lower()) if y else []
        for before, w, after in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
            for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                if (p := w[:k]) in around:
                    around[p].add((before, after))
    marks = {p for p in marks if len(around[p]) >= LEAST_CONTEXTS * often[p]}
    shortest = [p for p in marks if not any(p[:k] in marks for k in range(SHORTEST, len(p)))]
    more: dict[str, list[str]] = {}
    for p in often:
        more.setdefault(p[:-1], []).append(p)

    def longer(q: str) -> Counter:
        """By documents, the prefixes one letter longer, and the word that ends here."""
        if len(q) < LONGEST:
            return Counter({p: often[p] for p in more.get(q, [])})
        found: Counter = Counter()
        for ws, y in zip(words, toxic, strict=True):
            if y:
                found.update({w[: len(q) + 1] if len(w) > len(q) else w + "$" for w in ws if w.startswith(q)})
        return found

    out = {}
    for p in shortest:
        q, n = p, often[p]
        while True:
            best, least = next(iter(longer(q).most_common(1)), (None, 0))
            if best is None or least < LENGTHEN * n:
                break
            q, n = best, least
            if q[-1] == "$":
                break
        word = q.rstrip("$")
        stem = q[-1] != "$"
        edits = 0 if len(word) < 5 or stem and len(word) < 6 else 1 if len(word) < 9 else 2
        out[word] = (often[p], Term(word, stem, edits))
    return [t for _, t in sorted(out.values(), key=lambda x: (-x[0], x[1].text))]


class _State:
    __slots__ = ("after", "dead", "hit", "places")

    def __init__(self, places: frozenset, hit: int | None):
        self.places, self.hit, self.after, self.dead = places, hit, {}, not places


class Automaton:
    """The Levenshtein automaton of every term at once, over their trie, made deterministic as it is used.

    A place is (trie node, edits so far).  With ``whole`` the first letter may be edited like any other; without
    it the first letter must agree.  ``match`` gives the edits of the best hit, or -1; ``edits`` does too, but
    takes no ``ordinary`` word for a misspelling.
    """

    def __init__(self, terms: list[Term], whole: bool = False, ordinary: frozenset[str] = frozenset()):
        self.whole, self.ordinary = whole, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.words: list[int] = [-1]  # the edits allowed to a word, or a stem, that ends at a node
        self.stems: list[int] = [-1]
        self.room: list[int] = [0]  # the most edits allowed below a node
        for t in terms:
            at = 0
            self.room[0] = max(self.room[0], t.edits)
            for ch in t.text:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.words.append(-1)
                    self.stems.append(-1)
                    self.room.append(0)
                at = self.children[at][ch]
                self.room[at] = max(self.room[at], t.edits)
            ends = self.stems if t.stem else self.words
            ends[at] = max(ends[at], t.edits)
        self.states: dict[tuple, _State] = {}
        self.cache: dict[str, int] = {}
        self.start = self._state({(0, 0)}, None)

    def _state(self, places: set, stem_hit: int | None) -> _State:
        todo = [p for p in places if p[0] or self.whole]
        while todo:  # letters that the word lacks
            node, e = todo.pop()
            for child in self.children[node].values():
                p = (child, e + 1)
                if e + 1 <= self.room[child] and p not in places:
                    places.add(p)
                    todo.append(p)
        stem = min((e for node, e in places if self.stems[node] >= e), default=None)
        if stem is not None:
            stem_hit = stem if stem_hit is None else min(stem, stem_hit)
        key = (frozenset(places), stem_hit)
        if key not in self.states:
            self.states[key] = _State(*key)
        return self.states[key]

    def _step(self, state: _State, ch: str) -> _State:
        new = set()
        for node, e in state.places:
            if (child := self.children[node].get(ch)) is not None:
                new.add((child, e))
            if node or self.whole:
                if e + 1 <= self.room[node]:
                    new.add((node, e + 1))
                for other in self.children[node].values():
                    if e + 1 <= self.room[other]:
                        new.add((other, e + 1))
        least: dict[int, int] = {}
        for node, e in new:
            least[node] = min(e, least.get(node, 9))
        out = state.after[ch] = self._state({(n, e) for n, e in least.items()}, state.hit)
        return out

    def match(self, word: str) -> int:
        """Edits to the nearest term, -1 if none is near enough."""
        state = self.start
        for ch in word:
            state = state.after.get(ch) or self._step(state, ch)
            if state.dead:
                return -1 if state.hit is None else state.hit
        found = [e for node, e in state.places if self.words[node] >= e]
        if state.hit is not None:
            found.append(state.hit)
        return min(found, default=-1)

    def edits(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            got = self.match(word)
            got = self.cache[word] = -1 if got > 0 and word in self.ordinary else got
        return got


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks that close on the same line; a mark inside a span opens none."""
    out = []
    for line in LINE.finditer(text):
        s, done, open_ended = line.group(), 0, set()
        for m in OPENING.finditer(s):
            at, end = m.start(), QUOTES[m.group()]
            # a closing mark that this line lacks is looked for once
            if at < done or end in open_ended:
                continue
            close = s.find(end, at + 1)
            if close < 0:
                open_ended.add(end)
            else:
                done = close + 1
                out.append((line.start() + at, line.start() + done))
    return out


def inside(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether a position is in one of the spans, which are sorted and apart."""
    k = bisect_right(spans, (at, math.inf)) - 1
    return k >= 0 and at < spans[k][1]


def told(found: list[tuple[int, str]], i: int) -> bool:
    """Whether a reporting word is within the window around word ``i``, on either side."""
    return any(w in REPORTING for _, w in found[max(0, i - WINDOW) : i + WINDOW + 1])


def ordinary_words(texts: list[str], toxic: list[int], automaton: Automaton) -> frozenset[str]:
    """Words near a term that are words of their own: toxic documents hardly use them more often than clean ones.

    A use counts by document, outside quotation marks and away from reporting words; one stray document is not enough.
    """
    uses: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        low = text.lower()
        if not any(automaton.match(w) > 0 for w in set(WORD.findall(low))):
            continue
        found = [(m.start(), m.group()) for m in WORD.finditer(low)]
        spans = quoted_spans(low if len(low) != len(text) else text)
        plain = set()
        for i, (start, w) in enumerate(found):
            if automaton.match(w) > 0 and not inside(spans, start) and not told(found, i):
                plain.add(w)
        uses[y].update(plain)
    n0, n1 = max(1, len(toxic) - sum(toxic)), max(1, sum(toxic))
    return frozenset(w for w, n in uses[0].items() if n >= LEAST_CLEAN and uses[1][w] / n1 < LEAST_MISSPELT * n / n0)


def features(text: str, automaton: Automaton) -> list[float]:
    """Hits weighed by their windows and edits, the same by length, hits in other hits' windows, misspelt hits."""
    low = text.lower()
    if len(low) != len(text):
        text = low
    edits = automaton.edits
    if all(edits(w) < 0 for w in set(WORD.findall(low))):
        return [0.0, 0.0, 0.0, 0.0]
    found = [(m.start(), m.group()) for m in WORD.finditer(low)]
    hits = [(i, start, e) for i, (start, w) in enumerate(found) if (e := edits(w)) >= 0]
    spans = quoted_spans(text)
    total = near = together = 0.0
    last = -WINDOW * 2
    for i, start, e in hits:
        quoted = inside(spans, start)
        weight = (0.15 if quoted else 1.0) * (0.5 if told(found, i) else 1.0)
        together += weight * (i - last <= WINDOW)
        last = i
        total += weight * (1 - MISSPELT * e)
        near += weight * (e > 0)
    return [math.log1p(total), math.log1p(100 * total / (len(found) + 50)), math.log1p(together), math.log1p(near)]


@dataclass
class ToxicityModel:
    terms: list[Term] = field(default_factory=list)
    weights: list[float] | None = None  # the last is the constant
    ordinary: frozenset[str] = frozenset()  # words near a term that are no misspellings

    def score(self, text: str, automaton: Automaton) -> float:
        if self.weights is None:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, features(text, automaton), strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Newton's method; the constant is not held back by the ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    hold = np.diag([*[ridge * weight.sum()] * (x.shape[1] - 1), 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-12)[:, None]).T @ x + hold, x.T @ (weight * (p - y)) + hold @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    sample, of = labelled_texts(docs, labels, "toxic", rows, stratified=True)
    return fit_texts([t for t, _ in sample], [t for _, t in sample], of)


def fit_texts(texts: list[str], y: list[int], of: dict[int, int], chance: float = CHANCE) -> ToxicityModel:
    """The model of labelled texts; ``of`` counts each class in the whole labelled table."""
    if len(set(y)) < 2:
        return ToxicityModel()
    terms = learn_terms(texts, y, chance)
    ordinary = ordinary_words(texts, y, Automaton(terms, whole=True))
    automaton = Automaton(terms, whole=True, ordinary=ordinary)
    x = np.array([features(t, automaton) for t in texts])
    n = Counter(y)
    weight = np.array([of[t] / n[t] for t in y])  # as in the labelled table
    return ToxicityModel(terms, fit_logistic(x, np.array(y, float), weight / weight.mean()), ordinary)


_AUTOMATA: dict[str, Automaton] = {}


def automaton_of(model: ToxicityModel) -> Automaton:
    """One automaton for each lexicon in a worker process."""
    key = repr((model.terms, sorted(model.ordinary)))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(model.terms, whole=True, ordinary=model.ordinary)
    return _AUTOMATA[key]


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, keep: str, threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` (a DDL list, text among them if wanted), score and predicted."""
    names = [x.split()[0] for x in keep.split(",")]
    shared = spark.sparkContext.broadcast(model)

    def start():
        own = shared.value
        automaton = automaton_of(own)

        def work(part: dict) -> dict:
            scores = [own.score(t or "", automaton) for t in part["text"]]
            return {c: part[c] for c in names} | {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    return map_texts(docs.select(*dict.fromkeys([*names, "text"])), f"{keep}, score double, predicted int", start)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(spark, docs, fit(docs, labels), "doc_id long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
