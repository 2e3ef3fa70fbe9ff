"""Text functions as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed from lines and texts.
BLANK = " \t\n\r\x0b\x0c"

# Words that a keyword query leaves out.
STOP_WORDS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "is", "are", "was", "were", "be", "do", "does", "did", "what", "which", "who", "how",
    "why", "when", "where", "it", "this", "that", "with", "as", "at", "by", "from", "about", "can", "i", "me", "my", "you", "your",
)


def _folding() -> tuple[str, str]:
    """Letters with marks in the Latin, Greek and Cyrillic blocks and what they are without, then the marks themselves, which are nothing."""
    found = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if chr(code).lower() == chr(code) and len(base) == 1 and base[0] != chr(code):
            found[chr(code)] = base[0]
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(found) + marks, "".join(found.values())


#: For ``translate``, after ``lower``; the same in SQL.
ACCENTED, PLAIN = _folding()

# Where a sentence starts, what a heading is (its marks, its text), what parts the clauses of a question, what
# a search term is, and how hard wraps and hyphens of extracted pages are undone (pattern, replacement).
SENTENCE_START = r"(?<=[.!?])\s+(?=[A-Z\"'(\[])"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
CLAUSE_END = r"(?i)\s*(?:[,;?]|\band\b|\bor\b|\balso\b|\bplus\b)\s*"
TERM = r"[a-z0-9_]+(?:[.\-/][a-z0-9_]+)*"
PDF_REPAIRS = ((r"-\n(\w)", "{1}"), (r"(?<![.!?:;\n])\n(?![\n\s•\-*\d])", " "), (r"[ \t]{2,}", " "))

MAX_TERMS = 32


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def collapse(c: Column) -> Column:
    """No-break and repeated blanks to one, three line feeds or more to two, every line and the whole trimmed."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim(F.array_join(F.transform(F.split(c, "\n"), trim), "\n"))


def markup_to_text(c: Column) -> Column:
    """HTML without a parser: scripts and styles go, some tags end lines, other tags become blanks; entities stay."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n")
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def repair_pdf(c: Column) -> Column:
    """Undo hyphenation and hard wraps of extracted pages."""
    for pattern, by in PDF_REPAIRS:
        c = F.regexp_replace(c, pattern, by.replace("{1}", "$1"))
    return c


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines, trimmed, without empty ones; a heading line is a piece of its own."""
    c = F.regexp_replace(c, r"(?m)^([ \t]*#{1,6}[ \t]+\S.*)$", "\n\n$1\n\n")
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), trim), lambda p: p != "")


def heading_level(paragraph: Column) -> Column:
    """1 to 6 if the paragraph is a heading, else 0."""
    return F.length(F.regexp_extract(paragraph, HEADING, 1))


def heading_text(paragraph: Column) -> Column:
    return F.regexp_extract(paragraph, HEADING, 2)


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_START)


def tail(c: Column, n: int) -> Column:
    """The last n characters from the first sentence start in them, else all of them; nothing of a text that is not longer."""
    last = F.right(c, F.lit(n))
    at = F.regexp_instr(last, F.lit(SENTENCE_START))
    cut = F.when(at > 0, trim(F.substring(last, at, n))).otherwise(trim(last))
    return F.when(F.length(c) <= n, F.lit("")).otherwise(cut)


def title(text: Column, stem: Column) -> Column:
    """From the first 12 lines: a '#' line of 3 to 120 characters, or a line of 8 to 90 that begins with a capital and does not
    end with a full stop; else the file's stem."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 12), trim)

    def fits(line: Column) -> Column:
        bare = trim(F.regexp_replace(line, r"\A#+", ""))
        marked = line.startswith("#") & F.length(bare).between(3, 120)
        plain = F.length(line).between(8, 90) & line.rlike(r"\A[A-Z]") & ~line.endswith(".")
        return F.when(marked, bare).when(plain, line)

    found = F.filter(F.transform(lines, fits), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.translate(stem, "_-", "  "))


def strip_title(heading_title: Column, heading: Column) -> Column:
    """The breadcrumb without its first part if that is the title."""
    parts = F.filter(F.split(heading, " > "), lambda p: p != "")
    same = F.lower(F.try_element_at(parts, F.lit(1))) == F.lower(heading_title)
    return F.array_join(F.when(F.coalesce(same, F.lit(False)), F.slice(parts, 2, 1000)).otherwise(parts), " > ")


def trail(heading_title: Column, heading: Column) -> Column:
    return F.concat_ws(" > ", F.nullif(heading_title, F.lit("")), F.nullif(strip_title(heading_title, heading), F.lit("")))


def embed_text(heading_title: Column, heading: Column, body: Column) -> Column:
    above = trail(heading_title, heading)
    return F.when(above == "", body).otherwise(F.concat(above, F.lit("\n\n"), body))


def rerank_text(heading_title: Column, heading: Column, body: Column) -> Column:
    above, body = trail(heading_title, heading), F.substring(body, 1, 2000)
    return F.when(above == "", body).otherwise(F.concat(above, F.lit("\n"), body))


def citation(path: Column, heading_title: Column, page: Column, heading: Column) -> Column:
    """File name or, of a URI, the title; the page; the section."""
    name = F.when(F.contains(path, F.lit("://")), heading_title).otherwise(F.regexp_extract(path, r"([^/]*)\z", 1))
    section = strip_title(heading_title, heading)
    return F.concat(
        name,
        F.when(page > 0, F.concat(F.lit(" p."), page.cast("string"))).otherwise(""),
        F.when(section != "", F.concat(F.lit(" — "), section)).otherwise(""),
    )


def strip_thinking(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    return trim(F.regexp_replace(c, r"(?is)\A\s*<think>.*?(</think>|\z)", ""))


def query_terms(c: Column) -> Column:
    """Search terms of a question: ASCII tokens, joined ones kept, without stop words and single letters, the first 32 distinct.

    A question of stop words only keeps them."""
    tokens = F.filter(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1)
    kept = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(tokens)), 1, MAX_TERMS)


def index_tokens(c: Column) -> Column:
    """Tokens of the inverted index: runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_FOLD = dict(zip(ACCENTED, [*PLAIN, *[""] * (len(ACCENTED) - len(PLAIN))], strict=True))
_APART = {i: " " for i in range(128) if not chr(i).isalnum()}
_APART_BYTES = bytes(32 if i in _APART else i for i in range(256))


def tokens_of(text: str | None) -> list[str]:
    """As :func:`index_tokens`, for texts within a Python pass."""
    low = (text or "").lower()
    if not low.isascii():
        for c in _FOLD.keys() & set(low):  # a text has few distinct characters that are not ASCII: each is replaced at once
            low = low.replace(c, _FOLD[c])
    if not low.isascii():
        for c in set(low):
            if not (c.isascii() or c.isalnum()):
                low = low.replace(c, " ")
        return low.encode().translate(_APART_BYTES).decode().split()
    return low.translate(_APART).split()


def clauses(c: Column, *, least: int = 3, least_query: int = 7) -> Column:
    """Clauses of a compound question, or none."""
    parts = F.transform(F.split(c, CLAUSE_END), trim)
    long = F.filter(parts, lambda p: count_words(p) >= least)
    none = F.slice(parts, 1, 0)
    return F.when((count_words(c) >= least_query) & (F.size(long) >= 2), long).otherwise(none)


def slugs(items: Column) -> Column:
    found = F.transform(items, lambda s: F.replace(F.lower(F.array_join(words(s), " ")), F.lit(" "), F.lit("_")))
    return F.slice(F.filter(found, lambda s: s.rlike(r"\A[a-z0-9_\-]{2,40}\z")), 1, 20)


def facts(items: Column) -> Column:
    found = F.transform(items, lambda s: F.array_join(words(s), " "))
    return F.slice(F.filter(found, lambda s: F.length(s) >= 8), 1, 12)


def clean_choice(c: Column) -> Column:
    return F.regexp_replace(trim(F.btrim(trim(c), F.lit("*_"))), r"\s{2,}", " ")


def character_block(name: Column, role: Column, sheet: Column) -> Column:
    return F.concat(name, F.when(role != "", F.concat(F.lit(" — "), role)).otherwise(""), F.when(sheet != "", F.concat(F.lit("\n"), trim(sheet))).otherwise(""))


def pick(values: Sequence[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits as the SQL has it: the value times the power of ten, halves away from zero, divided again. ``F.round`` takes the
    shortest decimal instead, so values next to a half go another way, and small negative ones lose their sign."""
    scaled = F.abs(x) * float(10**digits)
    whole = F.floor(scaled).cast("double")
    up = whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.isnan(x) | (scaled >= 2.0**52), x).otherwise(F.signum(x) * (up / float(10**digits)))
