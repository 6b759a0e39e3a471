"""Names, lines and notes as they are shown: slugs of each kind, cut lines, what a failed call said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.text import fold

#: Characters of a first line, of a procedure's line, of a short text, of a complaint; and what stands for no line.
LINE, PROCEDURE, SHORT, COMPLAINT = 200, 160, 60, 300
NO_PROCEDURE = "A procedure this company approved."


def kebab(c: Column, parts: int) -> Column:
    """The first words of a title in lower case without Croatian marks; letters of other languages stay as they are."""
    words = F.filter(F.split(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "-"), "-"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, parts), "-")


def agent_slug(c: Column) -> Column:
    return kebab(c, 5)


def prompt_slug(c: Column) -> Column:
    return F.when(kebab(c, 6) == "", "skill").otherwise(kebab(c, 6))


def cassette_slug(c: Column) -> Column:
    """A dash for every character that is no ASCII letter or digit."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "-"))


def xml_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def cut(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def lines(c: Column) -> Column:
    return F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def first_line(c: Column) -> Column:
    """The first line that isn't blank, cut where it is long; empty if there is none."""
    return cut(F.coalesce(F.get(F.filter(lines(c), lambda x: x != ""), 0), F.lit("")), LINE)


def procedure_line(body: Column) -> Column:
    """The first line that is no heading."""
    said = F.get(F.filter(lines(body), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), 0)
    return F.substring(F.coalesce(said, F.lit(NO_PROCEDURE)), 1, PROCEDURE)


def flat(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def truncate(c: Column, most: int) -> Column:
    return cut(flat(c), most)


def short(c: Column) -> Column:
    return cut(c, SHORT)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def elapsed_seconds(at: Column, now: Column) -> Column:
    """Seconds since a moment given as text; 0 for none, one that can't be read, or one to come."""
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at.try_cast("timestamp"))), F.lit(0)).cast("long")


def running_note(engine: Column, phrase: Column) -> Column:
    none = phrase == ""
    return (
        F.when(engine.isNotNull() & none, F.concat(engine, F.lit(" is running"))).when(engine.isNotNull(), F.concat(engine, F.lit(" · "), phrase))
        .when(none, "running").otherwise(F.concat(F.lit("running for "), phrase))
    )


def complaint(said: Column) -> Column:
    """What went wrong out of an error output: its lines of complaint, each once, else all of it; of long ones the end."""
    low = lambda x: F.lower(x)
    found = F.array_distinct(F.filter(lines(said), lambda x: F.startswith(low(x), F.lit("error")) | F.contains(low(x), F.lit("error:")) | F.startswith(low(x), F.lit("fatal"))))
    whole = flat(F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(said))
    return F.when(F.char_length(whole) <= COMPLAINT, whole).otherwise(F.concat(F.lit("…"), F.right(whole, F.lit(COMPLAINT))))


def error_envelope(out: Column) -> Column:
    """The record in which an engine says that it failed: the whole output, else the first of its lines; null if none does."""
    kind = lambda x: F.coalesce(F.get_json_object(x, "$.type"), F.lit(""))
    failed = lambda x: (
        (kind(x) == "result") & F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), "$.is_error", "variant")) == "BOOLEAN", F.lit(False)) & (F.get_json_object(x, "$.is_error") == "true")
    ) | kind(x).isin("error", "turn.failed")
    record = lambda x: F.try_parse_json(x).isNotNull() & failed(x)
    return F.get(F.filter(F.concat(F.array(F.trim(out)), F.split(out, r"\r?\n")), record), 0)
