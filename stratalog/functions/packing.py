"""Cutting and packing texts for calls of bounded size, and line differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def chunk_text(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` bytes that end at a character, after the last blank line where that lies past the middle."""
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > most:
        end = at + most
        while end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        gap = raw.rfind(b"\n\n", at, end)
        end = gap + 2 if gap - at > (end - at) // 2 else end
        out.append(raw[at:end].decode())
        at = end
    return [*out, raw[at:].decode()] if at < len(raw) else out


def chunks(docs: DataFrame, most: int) -> DataFrame:
    """(id, part, text) of documents (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, c in enumerate(chunk_text(t or "", most))]
            yield pd.DataFrame(rows, columns=["id", "part", "text"])

    return docs.select("id", "text").mapInPandas(run, "id string, part long, text string")


def common_lengths(a: list[int], b: list[int]) -> list[int]:
    """The length of a longest common subsequence of ``a`` and each prefix of ``b``, with one row in memory."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = left = 0
        for k, y in enumerate(b, 1):
            above = row[k]
            left = row[k] = corner + 1 if x == y else max(above, left)
            corner = above
    return row


def common_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of one longest common subsequence, by halving ``a`` where both halves' lengths add up to the most."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        mid = (a0 + a1) // 2
        front = common_lengths(a[a0:mid], b[b0:b1])
        back = common_lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + max(range(len(front)), key=lambda k: front[k] + back[k])
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def diff_lines(before: str, after: str) -> list[tuple[str, str]]:
    """(same | del | add, line): lines of a longest common subsequence stay; between two of them what goes comes before
    what is new.  Memory is linear in the lines."""
    a, b = before.split("\n"), after.split("\n")
    number: dict[str, int] = {}
    pairs = common_pairs(*([number.setdefault(x, len(number)) for x in lines] for lines in (a, b)))
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += [("del", t) for t in a[i:x]] + [("add", t) for t in b[j:y]] + [("same", t) for t in a[x : x + 1]]
        i, j = x + 1, y + 1
    return out


def line_diff(versions: DataFrame) -> DataFrame:
    """(id, line, change, text) of versions (id, before, after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c, t) for i, x, y in zip(pdf["id"], pdf["before"], pdf["after"], strict=True) for k, (c, t) in enumerate(diff_lines(x or "", y or ""))]
            yield pd.DataFrame(rows, columns=["id", "line", "change", "text"])

    return versions.select("id", "before", "after").mapInPandas(run, "id string, line long, change string, text string")
