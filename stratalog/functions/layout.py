"""Places of nodes on the map of knowledge: clusters by kind, scattered by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the hash, its two mixing factors, where each kind gathers, how far it is scattered.
START, FACTOR, MIX = 2166136261, 16777619, (0x85EBCA6B, 0xC2B2AE35)
ANCHORS = {"rule": (-48, 26, 12), "process": (48, 15, -12), "skill": (20, 52, 30), "term": (-12, -38, 20), "fact": (-12, -38, 20), "document": (0, -8, -35)}
SPREAD, CENTRE = (72, 72, 90), 0.64
MASK = 0xFFFFFFFF


def times(a: Column, b: int) -> Column:
    """The product modulo 2**32 of a number below 2**32 and a constant, in halves so that no long overflows."""
    high = F.shiftleft((a * (b >> 16)).bitwiseAND(0xFFFF), 16)
    return (a * (b & 0xFFFF) + high).bitwiseAND(MASK)


def unit_hash(c: Column, salt: int = 0) -> Column:
    """A number from 0 on and below 1: FNV-1a with 32 bits over the UTF-16 units of a text, then mixed."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("...."), F.lit(0))
    h = F.aggregate(units, F.lit(START ^ salt).cast("long"), lambda h, u: times(h.bitwiseXOR(F.conv(u, 16, 10).cast("long")), FACTOR))
    for shift, factor in zip((16, 13), MIX, strict=True):
        h = times(h.bitwiseXOR(F.shiftright(h, shift)), factor)
    return h.bitwiseXOR(F.shiftright(h, 16)) / 4294967296.0


def place(c: Column, kind: Column) -> list[Column]:
    """x, y, z of a node by itself; kinds that aren't known gather with facts."""
    out = []
    for axis, spread in enumerate(SPREAD):
        anchor = F.lit(ANCHORS["fact"][axis])
        for name, at in ANCHORS.items():
            anchor = F.when(kind == name, at[axis]).otherwise(anchor)
        out.append(anchor + (unit_hash(c, axis + 1) - 0.5) * spread)
    return out
