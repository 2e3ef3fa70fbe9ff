"""Story-clock functions on timestamps without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trim

# The sign of each part of the day, by the hour at which it ends.
PARTS_OF_DAY = ((5, "🌙"), (8, "🌅"), (12, "🕘"), (17, "🕛"), (20, "🌆"), (24, "🌙"))
# Signs of the five options.
KEYCAPS = ("1️⃣", "2️⃣", "3️⃣", "4️⃣", "5️⃣")
#: Options that fill up a list that is too short.
FILLER = ("🗣️ Speak up", "🔍 Search the place", "🧭 Go somewhere else", "⏳ Bide your time", "🎲 Try something unexpected")
MOST_MINUTES = 43_200


def ordinal(day: Column) -> Column:
    ending = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), ending)


def parse(date: Column, time: Column) -> Column:
    return F.to_timestamp_ntz(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm"))


def fields(ts: Column) -> Column:
    """A struct of the clock's parts: date, time, weekday."""
    return F.struct(F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm").alias("time"), F.date_format(ts, "EEEE").alias("weekday"))


def pretty_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEEE, MMMM "), ordinal(F.dayofmonth(ts)), F.lit(", "), F.year(ts).cast("string"))


def pretty_time(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def hour_sign(hour: Column) -> Column:
    out = F.lit(PARTS_OF_DAY[-1][1])
    for end, sign in reversed(PARTS_OF_DAY[:-1]):
        out = F.when(hour < end, sign).otherwise(out)
    return out


def clamp_minutes(minutes: Column) -> Column:
    """0 to 43200; what is no number counts as 10."""
    return F.least(F.greatest(F.coalesce(minutes.try_cast("double"), F.lit(10.0)), F.lit(0.0)), F.lit(float(MOST_MINUTES))).cast("int")


def advance(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.greatest(minutes.cast("int"), F.lit(0)), F.lit(0))


def jump_to(ts: Column, date: Column, time: Column) -> Column:
    """Each part replaced on its own; a part that cannot be read is ignored."""
    day = F.coalesce(F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))), F.to_date(ts))
    clock = F.coalesce(F.date_format(F.try_to_timestamp(time, F.lit("HH:mm")), "HH:mm"), F.date_format(ts, "HH:mm"))
    return parse(F.date_format(day, "yyyy-MM-dd"), clock)


def header(ts: Column, title: Column) -> Column:
    return F.concat(F.lit("📅 "), pretty_date(ts), F.lit(" — "), hour_sign(F.hour(ts)), F.lit(" "), pretty_time(ts), F.lit(" — "), trim(title))


def entry(ts: Column, title: Column, narration: Column, choices: Column) -> Column:
    """An entry as it is shown: header, narration, question, numbered options."""
    caps = F.array(*[F.lit(k) for k in KEYCAPS])
    options = F.transform(F.slice(choices, 1, 5), lambda c, i: F.concat(F.element_at(caps, i + 1), F.lit(" "), c))
    return F.concat_ws("\n", header(ts, title), F.lit(""), trim(narration), F.lit(""), F.lit("**What will you do?**"), F.lit(""), F.array_join(options, "\n"))


def ensure_five(choices: Column) -> Column:
    return F.slice(F.concat(choices, F.array(*[F.lit(f) for f in FILLER])), 1, 5)


def resolve_input(raw: Column, pending: Column) -> Column:
    """The text of the option that a bare number or keycap stands for, else the trimmed input."""
    bare = trim(raw)
    chosen = F.when(bare.rlike(r"\A[1-5]\z"), F.try_element_at(pending, bare.try_cast("int")))
    for i, cap in enumerate(KEYCAPS):
        chosen = F.coalesce(chosen, F.when(bare.startswith(cap), F.try_element_at(pending, F.lit(i + 1))))
    return F.coalesce(chosen, bare)
