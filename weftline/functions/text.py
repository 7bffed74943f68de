"""String and date expressions, all on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of message type codes.
MEDIA = {
    1: "IMAGE", 38: "SEE_ONCE_IMAGE", 6: "SEE_ONCE_IMAGE", 2: "VIDEO", 39: "SEE_ONCE_VIDEO", 13: "SEE_ONCE_VIDEO", 3: "AUDIO", 4: "CONTACT",
    5: "LOCATION", 7: "URL", 8: "FILE", 11: "GIF", 14: "DELETED_MESSAGE", 15: "STICKER", 46: "POLL", 54: "VIDEO_NOTE",
}


def media_text(content: Column, message_type: Column, media_title: Column) -> Column:
    """Text of a message: its media label when empty, and its first link named by the title when there is one."""
    labels = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    empty = F.coalesce(content, F.lit("")) == ""
    text = F.when(empty & F.coalesce(message_type != 0, F.lit(False)), F.concat(F.lit("MEDIA: "), F.coalesce(F.try_element_at(labels, message_type.cast("int")), F.lit("UNKNOWN")))).otherwise(content)
    titled = F.regexp_replace(text, F.lit(r"^((?s:.*?))https://[^ ]*"), F.concat(F.lit("$1Sent a link: "), F.regexp_replace(media_title, r"([$\\])", r"\\$1")))
    return F.when(text.contains("https://") & (F.coalesce(media_title, F.lit("")) != ""), titled).otherwise(text)


def repeated_content(content: Column, n: Column) -> Column:
    """The content of a run: itself, or how often it was sent."""
    return F.when(n > 1, F.concat(F.lit("Sent "), n.cast("string"), F.lit(" of "), content)).otherwise(content)


def transcript(messages: Column, me: Column | str = "me", stamp: str = "datetime") -> Column:
    """array<struct<from, datetime | date, time, content>> to lines 'name at date time: content'; a line with a null part is left out."""
    me = F.lit(me) if isinstance(me, str) else me
    when = (lambda m: F.concat(m["date"].cast("string"), F.lit(" "), m["time"].cast("string"))) if stamp == "parts" else (lambda m: F.date_format(m[stamp], "yyyy-MM-dd HH:mm:ss"))
    line = lambda m: F.concat(F.when(m["from"] == "me", me).otherwise(m["from"]), F.lit(" at "), when(m), F.lit(": "), m["content"])
    return F.array_join(F.transform(messages, line), "\n")


def valid_time(t: Column) -> Column:
    return t.isNotNull() & F.coalesce(F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t), F.lit("yyyy-MM-dd HH:mm:ss")), F.lit(None)).isNotNull()


def relevance_period(start_date: Column, end_date: Column, start_time: Column, end_time: Column, compat: bool = False) -> Column:
    """The period a node speaks of. compat tests presence the wrong way round, as the original does; absent times then make it null."""
    has_start, has_end = valid_time(start_time), valid_time(end_time)
    if compat:
        has_start, has_end = ~has_start, ~has_end
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    same = F.when(~has_start & ~has_end, start_date.cast("string")).when(has_start & has_end & (start_time == end_time), join(start_date, " at ", start_time))
    same = same.when(has_start & has_end & (start_time != end_time), join(start_date, " from ", start_time, " to ", end_time)).when(has_start & ~has_end, join(start_date, " at ", start_time)).when(~has_start & has_end, join(start_date, " at ", end_time))
    apart = F.when(~has_start & ~has_end, join(start_date, " to ", end_date)).when(has_start & has_end, join(start_date, " at ", start_time, " to ", end_date, " at ", end_time))
    apart = apart.when(has_start, join(start_date, " at ", start_time, " to ", end_date)).otherwise(join(start_date, " to ", end_date, " at ", end_time))
    return F.when(start_date == end_date, same).when(start_date != end_date, apart)


def subject(text: Column, first: str, second: str) -> Column:
    """Which of two named people a text is about: one of the names, or 'both'. Names are taken literally, inside words too."""
    a, b = re.escape(first), re.escape(second)
    found = F.nullif(F.regexp_extract(text, f"({a}|{b})", 0), F.lit(""))
    return F.when(text.rlike(f"{a} and {b}|{b} and {a}"), F.lit("both")).otherwise(F.coalesce(found, F.lit("both")))


def clean_id(raw: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_row_prefix(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^row\d+_", "")


def node_datetime(datetimes: Column) -> Column:
    """'Unknown', the only one, or 'from first to last' of an array of date strings."""
    known = F.array_distinct(F.array_compact(datetimes))
    span = F.concat(F.lit("from "), F.array_min(known), F.lit(" to "), F.array_max(known))
    return F.when(F.coalesce(F.size(known), F.lit(0)) == 0, F.lit("Unknown")).when(F.size(known) == 1, F.element_at(known, 1)).otherwise(span)


def without_think(text: Column) -> Column:
    """A model's answer without its thoughts."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def fenced(text: Column) -> Column:
    """What stands in the first code fence, or all."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1), F.lit("")), text)


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def without_parens(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, broken at spaces where there are any."""
    return F.regexp_replace(text, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n")


def apple_time(seconds: Column) -> Column:
    """Seconds since 2001-01-01 as a timestamp."""
    return F.timestamp_seconds(seconds + F.lit(978_307_200))


def without_trailing(value: Column, sign: str = "s") -> Column:
    """value without any number of this sign at its end."""
    return F.rtrim(value, F.lit(sign))
