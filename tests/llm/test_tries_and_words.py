"""Decontamination, spelling groups and the conversation trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stratalog.llm import decontaminate, prefix_trie, spelling

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS, ITEMS = "doc_id long, text string, n_words string, uid int, wid int", "item_id long, text string, token int, class string"


def lower(s):
    return (s or "").encode().lower().decode()


def brute_decontaminate(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x] - {None}
        out.append((d, len(w), len(hit), len(found), SHA(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out, key=repr)


def run_decontaminate(spark, docs, items):
    d = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], DOCS)
    i = spark.createDataFrame([(a, b, 1, "c") for a, b in items], ITEMS)
    return sorted((tuple(r) for r in decontaminate.decontaminate(spark, d, i).collect()), key=repr)


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "ça", "naïve", "日本", "𝒳y"]
    line = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=n))
    items = [(i, line(r.choice([1, 2, 3, 5, 9, 10, 11, 40]) if i > 3 else 25)) for i in range(30)]
    items += [(40, items[2][1]), (2, "another text of the same id " + line(12)), (None, line(15)), (41, None), (42, " .,-"), (9, items[9][1])]
    docs = []
    for d in range(60):
        parts = [line(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1] or ""
            parts += [t.upper() if t.isascii() and r.random() < 0.5 else t, line(r.randint(0, 8))]
        docs.append((d, " ".join(parts)))
    docs += [(7, docs[7][1]), (7, "other"), (None, docs[3][1]), (100, None), (101, ""), (102, "--"), (103, "w1"), (104, items[0][1])]
    got = run_decontaminate(spark, docs, items)
    assert got == brute_decontaminate(docs, items)
    assert any(x[5] for x in got) and not all(x[5] for x in got)


def test_decontaminate_empty_tables(spark):
    assert run_decontaminate(spark, [], [(1, "a b c")]) == []
    assert run_decontaminate(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, 0, SHA(""), False), (2, 0, 0, 0, SHA(""), False)]


def test_decontaminate_long_texts_and_copies(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD", 100)
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(r.choices(["alpha", "beta", "gamma"], k=400_000)) + " " + passage + " x" * 50_000
    docs = [(1, long)] + [(k, passage) for k in range(2, 400)] + [(500, "y " * 5 + passage)]
    got = run_decontaminate(spark, docs, [(3, passage), (4, "beta beta beta beta beta beta beta beta beta beta")] + [(k, passage) for k in range(10, 20)])
    many = SHA(",".join(sorted(map(str, [3, *range(10, 20)]))))
    assert (2, 60, 60, 11, many, True) in got and (500, 65, 60, 11, many, True) in got
    assert [x for x in got if x[0] == 1][0][1] == 450_060 and len(got) == 400


def test_words_in_pieces_are_the_same(monkeypatch):
    data = ("one two  three, Ümlaut " * 40).encode().lower()
    whole = decontaminate.Words()(data)
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    cut = decontaminate.Words()(data)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) == 160
    assert [len(x) for x in decontaminate.Words()(b"")] == [0, 0, 0]


def brute_spelling(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            n[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def one(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    form, near = {}, {}
    for w in n:
        close = [x for x in n if one(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        near[w], form[w] = len(close), best if best and n[best] >= 10 * n[w] else None
    root = dict.fromkeys(n)
    for w in n:
        x = w
        while form[x]:
            x = form[x]
        root[w] = x
    return sorted((w, form[w], root[w], n[w], near[w], n[form[w]] if form[w] else None) for w in n) if n else []


def run_spelling(spark, docs):
    df = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], "doc_id long, text string, word string, n int, id int")
    return sorted((tuple(r) for r in spelling.group_spellings(spark, df).collect()))


def test_spelling_equals_brute_force(spark):
    r = random.Random(2)
    base = ["abababa", "aaaaaaaa", "größeren", "Straßenbahn", "necessary", "neccesary", "élégance", "committee"]
    seen = list(base)
    for w in base:
        for _ in range(12):
            k = r.randrange(len(w))
            seen.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abézß") + w[k:], w[:k] + r.choice("abéÿ") + w[k + 1 :]]))
    for w in list(seen[8:40]):
        k = r.randrange(len(w))
        seen.append(w[:k] + "q" + w[k:])
    weight = [300 if i < 8 else r.choice([1, 2, 3, 25]) for i in range(len(seen))]
    docs = [(d, r.choice([" ", "1", "×"]).join(x.upper() if x.isascii() and r.random() < 0.2 else x for x in r.choices(seen, weight, k=30))) for d in range(250)]
    docs += [(3, docs[3][1])] * 3 + [(None, docs[5][1]), (900, None), (901, ""), (902, "short words only")]
    got, want = run_spelling(spark, docs), brute_spelling(docs)
    assert [x for x in got if x not in want] == [] and len(got) == len(want)
    assert any(x[2] != (x[1] or x[0]) for x in got)  # a chain of forms


def test_spelling_long_words_and_empty_tables(spark):
    long = "ab" * 40_000
    docs = [(k, f"{long} {long[:-1]}c {'z' * 30_000}") for k in range(6)]
    assert run_spelling(spark, docs) == brute_spelling(docs)
    assert run_spelling(spark, []) == [] and run_spelling(spark, [(1, None)]) == []


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            d = SHA(f"{len((role or '').encode())}:{role or ''}{text or ''}")
            own[c].append((t is not None, t or 0, d, len(text or "")))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids, saved, leaves = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (p[-1][1] if p else 0)
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], SHA(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in nodes.items()
    )


def run_trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, n int")
    out = prefix_trie.conversation_trie(spark, df, **kw)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def talk():
    r = random.Random(6)
    rows = []
    for c in range(320):
        if c % 7 == 0 and c % 100:
            continue
        for t in range(r.randint(1, 9) if c != 200 else 2):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "user", r.choice(["hello", "hi ü", "how"]) if r.random() < 0.8 else f"own {c}"))
    rows += [(5000 + k, t, "user", "same") for k in range(40) for t in range(3)]  # no conversation 5000 % 100 is absent but 5000
    rows += [(7001, None, None, None), (7001, 1, "user", None), (7001, 1, None, "x"), (7001, 1, "user", ""), (None, 1, "user", "lost"), (7002, 3, "user", "a"), (7002, 3, "user", "a")]
    return rows


def test_trie_equals_brute_force(spark, talk):
    assert run_trie(spark, talk) == brute_trie(talk)


def test_trie_dealt_over_rounds_and_lone_sequences(spark, talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_TURNS", 50)  # long conversations count as hot
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = talk + [(9001, t, "user", f"long {t // 2}") for t in range(300)] + [(9002, 0, "user", "long 0")]
    assert run_trie(spark, rows, part_turns=25) == brute_trie(rows)


def test_trie_empty_and_turnless(spark):
    assert run_trie(spark, []) == [] and run_trie(spark, [(None, 1, "user", "x")]) == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its beginning is conversation 100's, which is absent
    rows = [(turnless, 0, "user", "gone")]
    assert run_trie(spark, rows) == brute_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, SHA(str(turnless)))]
