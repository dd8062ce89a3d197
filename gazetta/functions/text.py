"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: list[str]) -> Column:
    """Plain substring test in either case, without word boundaries."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return F.coalesce(out, F.lit(False))


def snippet(text: Column, n: int) -> Column:
    """The first n characters, line breaks as spaces."""
    return F.translate(F.substring(text, 1, n), "\n", " ")


def embedding_text(title: Column, body: Column, n: int = 500) -> Column:
    """Title, blank line, first n characters of the body, trimmed."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(body, F.lit("")), 1, n)))


def slug(text: Column, tokens: int = 4, width: int = 40, default: str = "drop") -> Column:
    """The first alphanumeric tokens, joined by hyphens."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    # The cut may leave a hyphen at the end.
    made = F.rtrim(F.substring(F.array_join(F.slice(words, 1, tokens), "-"), 1, width), F.lit("-"))
    return F.when(F.coalesce(made, F.lit("")) == "", default).otherwise(made)


def clean_label(text: Column, width: int = 48, default: str = "story") -> Column:
    """One line, cut at a word boundary, without closing punctuation."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(flat, 1, width)
    whole = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    made = F.regexp_replace(F.when(F.length(flat) > width, whole).otherwise(flat), r"[ ,.;:\-]+$", "")
    return F.when(made == "", default).otherwise(made)


#: Sides of a coverage breakdown (each before a percentage), units of a relative time, words after a shortened text, and marks that end no headline.
SIDES = ["Left", "Right", "Center"]
AGES = ["minute", "hour", "day"]
MORE = ["Show more"]
OPEN_END = " ,;:-—"


def clean_headline(text: Column, width: int = 160) -> Column:
    """One line, cut before the first thing that belongs to the page and not to the headline, without open marks at the end."""
    stops = [rf"{side} \d+ ?%" for side in SIDES] + [rf"\d+ {age}s? ago(?!\w)" for age in AGES] + [rf"{words}(?!\w)" for words in MORE]
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    at = F.regexp_instr(flat, F.lit(" (?:" + "|".join(stops) + ")"))
    kept = F.when(at > 0, F.substr(flat, F.lit(1), at - 1)).otherwise(flat)
    return F.rtrim(F.substring(F.trim(kept), 1, width), F.lit(OPEN_END))


def bare_urls(text: Column) -> Column:
    """How many links stand outside Markdown's parentheses."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?<!\]\()https?://"), F.lit(0)))


def script_ratio(text: Column, ranges: str) -> Column:
    """The share of letters that lie in a regex class; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(ranges)) / letters).otherwise(F.lit(0.0))


def in_script(text: Column, source_chars: Column, ranges: str | None, least_share: float = 0.2, least_length: float = 0.25) -> Column:
    """Whether a translation is one: not shorter than a share of its source, and with enough of its letters in the script. Without a script only the length counts; no letters fail."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    long_enough = F.length(flat) >= F.lit(least_length) * F.greatest(source_chars, F.lit(1))
    return long_enough if ranges is None else long_enough & (script_ratio(flat, ranges) >= least_share)


def humanise(n: Column) -> Column:
    """66000 as 66K; tenths rounded half up, a zero tenth left out."""
    size = F.abs(n)

    def unit(by: float, mark: str) -> Column:
        tenths = F.floor(size / F.lit(by) * 10 + 0.5).cast("long")
        rest = F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))
        return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), rest, F.lit(mark))

    return F.when(size >= 1e12, unit(1e12, "T")).when(size >= 1e9, unit(1e9, "B")).when(size >= 1e6, unit(1e6, "M")).when(size >= 1e3, unit(1e3, "K")).otherwise(unit(1.0, ""))


def phone(text: Column) -> Column:
    """A plus sign and at least eight digits, separators dropped."""
    found = F.regexp_replace(F.regexp_extract(text, r"\+[0-9][0-9 ().-]{6,}[0-9]", 0), "[^0-9+]", "")
    return F.when(F.length(found) >= 9, found)


def named(text: Column, offered: list[str]) -> Column:
    """Which of the offered words a text names, in the order they are offered; plain substrings in either case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in offered]), lambda w: (w != "") & F.contains(low, F.lower(w)))


def sign_up(text: Column, topics: list[str], lengths: list[str]) -> Column:
    """(phone, topics, length) of a sign-up: the first phone number, all offered topics, the first offered length that it names."""
    return F.struct(phone(text).alias("phone"), named(text, topics).alias("topics"), F.try_element_at(named(text, lengths), F.lit(1)).alias("length"))


def tolerant_timestamp(text: Column) -> Column:
    """ISO time with Z, an offset or none (UTC); null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
