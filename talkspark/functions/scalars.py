"""Column functions: names, clocks, text, vectors, file names. Times are integer milliseconds on the recording's clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def normalised(text: Column) -> Column:
    """Text with white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def display_name(label: Column, speaker: Column) -> Column:
    """The label, trimmed, or the speaker where the label is blank."""
    return F.coalesce(blank_to_null(label), speaker)


def line_key(speaker: Column, start_ms: Column) -> Column:
    return F.struct(speaker.alias("speaker"), start_ms.alias("start_ms"))


def line_key_of_seconds(speaker: Column, start: Column) -> Column:
    """The key of a line whose start is in seconds, to the millisecond, so that noise in a file's doubles doesn't matter."""
    return line_key(speaker, F.round(start * 1000).cast("long"))


def clock(ms: Column) -> Column:
    """HH:MM:SS, whole seconds, negative as zero, wrapping at a day."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0)) % 86400
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def rendered(start_ms: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), clock(start_ms), F.lit("] "), name, F.lit(": "), text)


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared time of two spans, zero if apart; null if a bound is null (greatest and least skip nulls)."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull(), shared)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """Cosine; -1 for an empty or zero vector. Other widths raise, or are null (no match) if not strict."""
    both = norm(a) * norm(b)
    value = F.when((F.size(a) == 0) | (both == 0), F.lit(-1.0)).otherwise(dot(a, b) / both)
    apart = F.raise_error(F.lit("embedding widths differ")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) != F.size(b), apart).otherwise(value)


def safe_file_name(name: Column) -> Column:
    """A name as a file name: slashes as dashes, NUL dropped; NAME-ME where nothing is left."""
    return F.coalesce(blank_to_null(F.translate(F.coalesce(name, F.lit("")), "/\x00", "-")), F.lit("NAME-ME"))


def slug(name: Column) -> Column:
    """Lower-case letters and digits with dashes between, 40 characters at most."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(plain, "^-|-$", ""), 1, 40)


def suggestion_suffix(name: Column, suggested: Column, score: Column) -> Column:
    """The given name; else suggested_0.87; else NAME-ME."""
    guess = F.format_string("%s_%.2f", suggested, score)
    return F.coalesce(blank_to_null(name), F.when(suggested.isNotNull(), guess), F.lit("NAME-ME"))


def contains_any(text: Column, fragments: Column) -> Column:
    """Whether one of the fragments is in the text, whatever the case."""
    return F.exists(fragments, lambda f: F.contains(F.lower(text), F.lower(f)))


def granularity(quality: Column, output: Column, expected: Column) -> Column:
    """Quality less the share by which the lengths differ, not under zero."""
    off = F.abs(F.length(output) - F.length(expected)) / F.greatest(F.length(expected), F.lit(1))
    return F.greatest(F.lit(0.0), quality - off)


def per_second(amount: Column, seconds: Column) -> Column:
    """Null where the amount or the time is missing or the time is zero."""
    return F.when(seconds > 0, amount / seconds)


def probe_end(end_ms: Column, probe_ms: int = 300_000) -> Column:
    return F.least(end_ms, F.lit(probe_ms))


def recording_day(created: Column, modified: Column) -> Column:
    return F.date_format(F.coalesce(created, modified), "yyyy-MM-dd")


def frontmatter(title: Column, day: Column, speakers: Column, note: Column) -> Column:
    """Title, date and speakers as JSON strings, the note as a block; empty where nothing is known."""
    json_text = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    parts = F.concat_ws(
        "\n",
        F.when(blank_to_null(title).isNotNull(), F.concat(F.lit("title: "), json_text(title))),
        F.when(day.isNotNull(), F.concat(F.lit("date: "), json_text(day))),
        F.when(F.size(speakers) > 0, F.concat(F.lit("speakers: "), F.to_json(speakers))),
        F.when(
            blank_to_null(note).isNotNull(),
            F.concat(F.lit("note: |\n"), F.array_join(F.transform(F.split(F.trim(note), "\n"), lambda x: F.concat(F.lit("  "), x)), "\n")),
        ),
    )
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("---\n"), parts, F.lit("\n---\n")))


def reply_json(reply: Column, schema: str) -> Column:
    """The first JSON object in a model's reply, after thinking and code fences are taken off."""
    plain = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    plain = F.regexp_replace(plain, r"(?s)^.*</think>", "")
    plain = F.regexp_replace(plain, r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0), schema)
