"""Display and classification functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.text import fold


def duration_phrase(seconds: Column) -> Column:
    """Whole minutes, from the first hour on whole hours; nothing before the first minute."""
    of = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(u))
    return F.when(seconds < 60, "").when(seconds < 3600, of(seconds / 60, " min")).otherwise(of(seconds / 3600, " h"))


def human_bytes(n: Column) -> Column:
    scaled = lambda by, u: F.concat(F.format_string("%.1f", F.floor(n * 10 / by) / 10), F.lit(u))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, " KB"))
        .when(n < 1024**3, scaled(1024**2, " MB")).otherwise(scaled(1024**3, " GB"))
    )


def spend_phrase(tokens: Column, cents: Column) -> Column:
    """``1,234 tokens · $0.12``; without a price only the tokens."""
    words = F.concat(F.format_number(tokens, 0), F.when(tokens == 1, " token").otherwise(" tokens"))
    return F.when(cents.isNull(), words).otherwise(F.concat(words, F.lit(" · $"), F.format_string("%d.%02d", F.floor(cents / 100), F.pmod(cents, F.lit(100)))))


def confidence_phrase(score: Column) -> Column:
    return F.when(score >= 0.85, "certain").when(score >= 0.6, "likely").when(score >= 0.35, "uncertain").otherwise("doubtful")


def confidence(agreeing: Column, quotes: Column, conflict: Column) -> Column:
    """0.68, more for agreeing documents and further quotes, less for a conflict; from 0.05 to 0.98."""
    raw = F.lit(0.68) + 0.12 * F.least(F.greatest(agreeing - 1, F.lit(0)), F.lit(2)) + F.when(quotes > 1, 0.04).otherwise(0.0) - F.when(conflict, 0.35).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.98), raw)), 6)


def wire_status(status: Column) -> Column:
    return F.when(status == "proposed", "draft").when(status == "conflicted", "conflict").otherwise(status)


def gate(status: Column, n_evidence: Column) -> Column:
    """What may be served: approved with evidence in full, open ones by name only, the rest withheld."""
    return F.when((status == "approved") & (n_evidence > 0), "full").when(status.isin("proposed", "conflicted"), "name_only").otherwise("withheld")


def attribute_app(client: Column) -> Column:
    """The application that a client's name speaks of, the more specific names first; null if none."""
    low = F.lower(client)
    holds = lambda name: F.contains(low, F.lit(name))
    return (
        F.when(holds("codex"), "codex").when(holds("cursor"), "cursor")
        .when(holds("claude-code") | holds("claude code") | (low == "claude_code"), "claude_code").when(holds("claude"), "claude_desktop")
    )


#: What a failed call says when its account is used up, nobody is signed in, or the line is down.
EXHAUSTED = (
    "insufficient_quota", "exceeded your current quota", "usage limit", "out of credits", "insufficient credits",
    "credit balance", "hit your limit", "reached your limit", "quota exceeded",
)
SIGNED_OUT = (
    "not logged in", "sign in", "login", "unauthorized", "401", "no credentials", "expired token",
    "authentication failed", "authentication_error", "please log in",
)
LINE_DOWN = (
    "rate limit", "429", "timeout", "timed out", "connection", "network", "unreachable", "temporarily unavailable",
    "503", "502", "overloaded",
)


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(c, F.lit(w)) for w in words))


def classify_error(message: Column) -> Column:
    """Used up or signed out wait for the owner; a line that is down is tried again; anything else was refused."""
    low = F.lower(message)
    return (
        F.when(holds_any(low, EXHAUSTED), "unavailable_quota").when(holds_any(low, SIGNED_OUT), "unavailable_login")
        .when(holds_any(low, LINE_DOWN), "transport").otherwise("refused")
    )


def backoff_seconds(attempts: Column, job_id: Column, base: int = 5) -> Column:
    """Seconds to the next try, doubling, with a spread by the job's id as wide as they are; dead (-1) from the sixth attempt."""
    wait = F.lit(base) * F.pow(F.lit(2), attempts).cast("long")
    return F.when(attempts >= 6, -1).otherwise(wait + F.pmod(job_id, wait)).cast("long")


#: Fixed values, folded: parts of the names of documents about persons, and of blank forms.
PERSONAL = ("place", "placa", "payroll", "zaposlenici", "ugovor-o-radu", "bolovanje")
TEMPLATE = ("predlozak", "template", "obrazac", "sablona")


def skip_reason(name: Column, text: Column, table: Column) -> Column:
    """Why a document isn't read for claims: personal, a template, or too short; null if it is read."""
    low = fold(name)
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        F.when(holds_any(low, PERSONAL), "personal").when(holds_any(low, TEMPLATE), "template")
        .when(F.octet_length(trimmed) < F.when(table, 1).otherwise(30), "too_short")
    )


def wants_rows(body: Column) -> Column:
    low = F.lower(body)
    return low.rlike("€|eur|price|cijena|cjenik|costs") | (low.contains("term") & low.contains("iznos"))


#: Names and endings of files that hold secrets, names of files that say nothing, a pattern of old versions.
SECRET_NAMES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials.json", "serviceaccount.json", "secrets.json", "auth.json")
SECRET_ENDINGS = (".pem", ".key", ".pfx", ".p12", ".keystore", ".jks", ".env", ".env.local", ".env.production")
NOISE_NAMES = ("thumbs.db", "desktop.ini")
OLD = r"\([0-9]+\)$|(^|[ _-])(old|backup|copy|kopija|stari|stara|staro|archive)([ _-]|$)|(^|[ _-])(v|ver|rev)[ ._-]?[0-9]+$"


def is_noise(name: Column) -> Column:
    """Lock files, hidden files, folder settings, and all secrets."""
    return F.startswith(name, F.lit("~$")) | F.startswith(name, F.lit(".")) | F.lower(name).isin(*NOISE_NAMES) | is_secret(name)


def is_secret(name: Column) -> Column:
    low = F.lower(name)
    return reduce(or_, (F.endswith(low, F.lit(e)) for e in SECRET_ENDINGS), low.isin(*SECRET_NAMES))


def is_old_version(name: Column) -> Column:
    """By the name without its extension."""
    return F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "").rlike(OLD)


def stale_warning(stale_since: Column) -> Column:
    """A sentence with the date part of when something below changed; null if nothing did."""
    return F.when(stale_since.isNotNull(), F.concat(F.lit("Something this rests on changed on "), F.split_part(stale_since, F.lit("T"), F.lit(1)), F.lit(".")))


def may_run(policy: Column, on_battery: Column) -> Column:
    """Whether model calls may run now: always, never, or only on mains power."""
    return F.when(policy == "always", True).when(policy == "never", False).otherwise(~on_battery)


#: The keys of a job's payload that name its subject, and what jobs without a subject are about.
SUBJECT_KEYS = ("document_id", "source_id", "id", "root")
WHOLE = {
    "settle": "Everything read so far", "relate": "Connections between everything", "supervise": "Company knowledge build", "draft_skills": "Skills",
    "recheck": "Quotes already approved",
}


def job_subject(payload: Column) -> Column:
    """The first of SUBJECT_KEYS that a payload has."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in SUBJECT_KEYS])


def whole_lake(kind: Column) -> Column:
    """What a job is about that names no subject."""
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), WHOLE.items(), F.when(F.lit(False), "")).otherwise("Your company")


def work_line(note: Column, error: Column, subject: Column) -> Column:
    """The note, else the error, without the subject and colon before it; "started" where there is neither."""
    said, head = F.coalesce(note, error, F.lit("started")), F.concat(subject, F.lit(": "))
    return F.when(F.startswith(said, head), F.substr(said, F.length(head) + 1)).otherwise(said)
