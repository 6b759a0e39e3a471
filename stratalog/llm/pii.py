"""Personal data: candidates from high-recall generators, chosen by boosted trees.

Four base kinds are found by their exact rules and always stay.  Further generators propose spans that may
overlap them and each other: spelled-out e-mail addresses, telephone numbers without a plus, bank and social
security numbers, IPv6 addresses, passwords and keys.  Boosted trees look at a candidate's format (lengths,
kinds of characters, groups, checksum, entropy) and context (words before it, neighbouring characters) and give
a calibrated probability; each kind has a threshold of its own, the lowest that holds the wanted precision on
rows set aside.

No table labels personal data, so the trees are trained on examples drawn from a seeded grammar of true and
false candidates; nothing is learned from the documents.  The driver trains them once and broadcasts them.

Behaviour: a null text is an empty one and has no spans; spans are code points, end exclusive; repeated rows
have the same spans; rows without an id or with the id of another are rows of their own; a span has no greatest
length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from functools import cache
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import boosting
from stratalog.llm.common import map_texts

#: The kinds in the order that spans at one place are listed, base kinds first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_words", "number", "iban", "ipv6", "secret", "key")
KINDS = (*BASE, *ADDED)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")  # a match can begin only where a run of digits does
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

GENERATORS = {
    "mail_words": re.compile(r"[\w.+-]{1,64} ?(?:[(\[{](?:at|AT)[)\]}]|(?<= )(?:at|AT)(?= )) ?[\w-]{1,64}(?: ?(?:[(\[{](?:dot|DOT)[)\]}]|(?<= )(?:dot|DOT)(?= )|\.) ?[\w-]{2,64}){1,4}"),
    "number": re.compile(r"(?<![\w+.])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,18}(?!\w)"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])"),
    "secret": re.compile(r"(?<=[=:]) ?[\"']?[^\s\"'=:]{6,}+(?:={1,2}(?![^\s\"'.,;)]))?"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9_]{16,}+(?![A-Za-z0-9])"),
}
#: Keys written with other characters too, proposed beside their parts: dotted web tokens and long Base64.
LONGER = re.compile(
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)+"
    r"|(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{40})(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9]++(?:[+/]++[A-Za-z0-9]*+)++={0,2}"
)
#: What a text must hold for a generator to run at all: every match of the generator holds its hint.
HINTS = {
    "mail_words": re.compile(r"[(\[{](?:at|AT)[)\]}]| (?:at|AT) [\w-]{1,64} ?(?:[(\[{](?:dot|DOT)[)\]}]|(?<= )(?:dot|DOT)(?= )|\.) ?[\w-]{2}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ipv6": re.compile(r":[0-9a-fA-F]{1,4}:"), "secret": re.compile(r"[=:]"),
    "key": re.compile(r"[0-9]"), "number": re.compile(r"[0-9]"),
}
#: Words before a candidate, fixed values, by what they speak of.
CUES = {
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"),
    "bank": ("iban", "account", "card", "bank", "visa"),
    "id": ("ssn", "social security", "passport", "tax id", "insurance"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "auth", "credential"),
    "mail": ("mail", "contact", "write", "reach"),
    "plain": ("version", "isbn", "order", "invoice", "page", "item", "total", "price", "year", "http", "www", "ref", "sku", "line", "time", "date"),
}
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds by their exact rules, sorted."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the generators propose, without those inside a base span."""
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))  # the last end of the base spans up to each
    out = []
    for kind in ADDED:
        if not HINTS[kind].search(text):
            continue
        found = GENERATORS[kind].finditer(text)
        for m in chain(found, LONGER.finditer(text)) if kind == "key" else found:
            start = m.start() + (len(m.group()) - len(m.group().lstrip(" \"'")) if kind == "secret" else 0)
            end = m.end()
            if kind == "secret":
                while end > start and text[end - 1] in ".,;)":
                    end -= 1
            before = bisect_right(starts, start)
            if end > start and not (before and furthest[before - 1] >= end):
                out.append((start, KINDS.index(kind), end))
    return out


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """The features of one candidate: its format, then its context."""
    s = text[start:end]
    n = len(s)
    d = digits_of(s)
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    groups = re.findall(r"[0-9]+", s)
    counts = Counter(s)
    before = text[max(0, start - CONTEXT) : start].lower()
    after = text[end : end + 1]
    return [
        *(float(kind == KINDS.index(k)) for k in ADDED),
        n, len(d), upper, lower, n - len(d) - upper - lower, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(len(d) >= 12 and luhn(d)),
        float(s[:1] in "(0123456789"), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        sum((a.isdigit() != b.isdigit()) for a, b in zip(s, s[1:], strict=False)),
        float("(at)" in s.lower() or "[at]" in s.lower() or "{at}" in s.lower() or " at " in s.lower()), float("dot" in s.lower()),
        float(s.count("-")), float(s.count(" ")), float(s.count("/")), float(s.count(".")),
        *(float(any(w in before for w in words)) for words in CUES.values()),
        float(before[-1:] in ("", " ", "\n", '"', "'", "=", ":", "(")), float(after in ("", " ", "\n", '"', "'", ".", ",", ")")),
        float(text[max(0, start - 1) : start] == "="), float(text[max(0, start - 1) : start] in ('"', "'")),
    ]


def examples(seed: int = 6, each: int = 300) -> tuple[list[list[float]], list[int], list[int]]:
    """Features, kinds and truth of candidates drawn from a grammar of true and false forms."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: some(low, r.randint(2, 9))
    cue = lambda group: r.choice(CUES[group])
    true = {
        "mail_words": lambda: r.choice([f"{word()}{digits(2)} (at) {word()} (dot) com", f"{word()} at {word()} dot org", f"{word()}.{word()}[at]{word()}[dot]net", f"{word()} (at) {word()}.com", f"{word()}.{word()} at {word()}.com", f"{word()} at {word()}.org"]),
        "number": lambda: r.choice([f"{cue('phone')} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{cue('phone')}: 0{digits(2)}/{digits(3)}-{digits(4)}", f"{cue('id')} {digits(3)}-{digits(2)}-{digits(4)}", f"{cue('phone')} 0{digits(3)} {digits(6)}", f"({digits(3)}) {digits(3)}-{digits(4)}"]),
        "iban": lambda: r.choice([f"{some(up, 2)}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"{cue('bank')} {some(up, 2)}{digits(18)}"]),
        "ipv6": lambda: ":".join(some("0123456789abcdef", r.randint(3, 4)) for _ in range(r.randint(6, 8))),
        "secret": lambda: r.choice([f"password={some('0123456789abcdef', r.randint(10, 20))}", f'{cue("secret")} = "{some("0123456789abcdef", 40)}"', f"{cue('secret')}: {some(low + up + '0123456789!#$', r.randint(8, 24))}", f"{cue('secret')}={some(low + '0123456789', r.randint(8, 32))}"]),
        "key": lambda: r.choice([f"AKIA{some(up + '234567', 16)}", f"{cue('secret')} {some(low + up + '0123456789', r.randint(20, 40))}", f"sk_{some(low + '0123456789', 24)}", f"ghp_{some(low + up + '0123456789', 36)}"]),
    }
    false = {
        "mail_words": lambda: r.choice([f"{word()} at {word()}. {word().title()} the", f"look at {word()} . {word()}", f"{word()} at the {word()}.{word()} dot"]),
        "number": lambda: r.choice([f"{cue('plain')} {r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{cue('plain')} {digits(2)}/{digits(2)}/{r.randint(1900, 2030)}", f"{cue('plain')} {digits(r.randint(7, 11))}", f"{digits(13)}", f"{digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)}", f"{digits(16)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(2)}-{digits(2)} {digits(2)}-{digits(2)}"]),
        "iban": lambda: r.choice([f"{cue('plain')} {some(up, 2)}{digits(2)} {some(up, 4)} {some(up, 4)}", f"{some(up, 2)}{digits(2)}{some(up, 8)}"]),
        "ipv6": lambda: r.choice([":".join(digits(2) for _ in range(4)), ":".join(digits(1) for _ in range(5))]),
        "secret": lambda: r.choice([f"http://{word()}.com/{word()}", f"{word()}: {word()}{word()}", f"page={digits(6)}", f"{word()}={word()}{word()}", f"note: {word()}, {word()}", f"lang={word()}{word()}"]),
        "key": lambda: r.choice([f"{word()}{word()}{word()}_{word()}{digits(1)}", f"{digits(r.randint(16, 24))}", f"{word()}_{word()}_{word()}_{digits(2)}", f"{cue('plain')} {digits(18)}"]),
    }
    x, kinds, y = [], [], []
    for k in range(each):
        for truth, forms in ((1, true), (0, false)):
            for form in forms.values():
                text = f"{word()} {word()} {form()}{r.choice(['', ' ', '. ', ', ', chr(10)])}{word() if k % 2 else ''}"
                for start, kind, end in candidates(text, base_spans(text)):
                    x.append(describe(text, start, kind, end))
                    kinds.append(kind)
                    y.append(truth)
    return x, kinds, y


Detector = tuple[boosting.Boosted, tuple[float, ...]]


@cache
def trained(precision: float = 0.98) -> Detector:
    """The trees and the threshold of each kind, lowest that keeps ``precision``.

    Three fifths of the examples grow the trees, one calibrates them and the last one gives the thresholds.
    """
    x, kinds, y = (np.array(v, dtype=float) for v in examples())
    order = np.random.default_rng(6).permutation(len(x))
    x, kinds, y = x[order], kinds[order], y[order]
    fold = np.arange(len(x)) % 5
    model = boosting.fit(x, y, fold < 3, fold == 3)
    rest = fold == 4
    score = model.scores(x)
    limits = []
    for k in range(len(KINDS)):
        own = rest & (kinds == k)
        best = 1.01
        for t in sorted(set(score[own]), reverse=True):
            took = own & (score >= t)
            if y[took].mean() >= precision:
                best = t
        limits.append(max(0.5, best) if k >= len(BASE) else 0.0)
    return model, tuple(limits)


def find_spans(texts: list[str], detector: Detector | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, as (start, kind, end)."""
    model, limits = detector or trained()
    base = [base_spans(t) for t in texts]
    asked = [(i, c) for i, t in enumerate(texts) for c in candidates(t, base[i])]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if asked:
        score = model.scores(np.array([describe(texts[i], *c) for i, c in asked]))
        for (i, c), s in zip(asked, score, strict=True):
            if s >= limits[c[1]]:
                added[i].append(c)
    return [(b, sorted({*b, *a})) for b, a in zip(base, added, strict=True)]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the first one's kind in brackets."""
    out, done, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i < len(spans) and spans[i][0] < max(end, start + 1):
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def start():
        detector = shared.value

        def work(part: dict) -> dict:
            found = find_spans([t or "" for t in part["text"]], detector)
            out: dict[str, list] = {"doc_id": part["doc_id"]}
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"] = [sum(s[1] == k for s in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [spell(spans) for _, spans in found]
            return out

        return work

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), schema, start)


def redact_documents(docs: DataFrame, keep: str) -> DataFrame:
    """The columns ``keep`` (a DDL list with text and n_chars) with every span of the text replaced; null stays null."""
    names = [x.split()[0] for x in keep.split(",")]
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def start():
        detector = shared.value

        def work(part: dict) -> dict:
            texts = part["text"]
            clean = [None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, find_spans([t or "" for t in texts], detector), strict=True)]
            return {c: part[c] for c in names} | {"text": clean, "n_chars": [None if t is None else len(t) for t in clean]}

        return work

    return map_texts(docs.select(*names), keep, start)
