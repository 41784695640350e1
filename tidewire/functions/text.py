"""Text expressions over news titles and summaries (X8-X15, X17). All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond blank, tab and line ends, inside a regex class.
RARE_ASCII_BLANKS = r"\x{0b}\f\x{1c}-\x{1f}"
RARE_BLANKS = (
    RARE_ASCII_BLANKS + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
COMMON_BLANKS = ("\n", "\t", "\r")
BLANK_CLASS = r" \n\t\r" + RARE_BLANKS
# The characters a title or summary may consist of, inside a regex class.
ALLOWED_CLASS = BLANK_CLASS + r"""a-zA-Z0-9.,!?;:'"’“”()\[\]{}\-–—_/\\$%&+*=#@"""
# The ASCII characters that are left out of it.
_ALLOWED = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), ALLOWED_CLASS) + "]")
FOREIGN_ASCII = "".join(f"\\x{{{i:02x}}}" for i in range(128) if not _ALLOWED.match(chr(i)))
# Curly quotes and what replaces them (the opening single quote stays).
QUOTES = {"’": "'", "“": '"', "”": '"'}


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def collapse_blanks(text: Column) -> Column:
    """Every run of Unicode white space becomes one blank.

    Common white space goes by plain replacement; a pattern with the wide character classes only
    runs over text that is not pure ASCII, where it would cost most of the time.
    """
    plain = F.when(_is_ascii(text), F.regexp_replace(text, f"[{RARE_ASCII_BLANKS}]", " ")).otherwise(
        F.regexp_replace(text, f"[{RARE_BLANKS}]", " ")
    )
    for blank in COMMON_BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.regexp_replace(plain, " {2,}", " ")


def straighten_quotes(text: Column) -> Column:
    """Closing single and both double curly quotes become plain ones."""
    for curly, straight in QUOTES.items():
        text = F.replace(text, F.lit(curly), F.lit(straight))
    return text


def tidy(text: Column) -> Column:
    """X8, X9 and X10's trim, in that order."""
    return F.trim(straighten_quotes(collapse_blanks(text)))


def trimmed_lower(text: Column) -> Column:
    """Without blanks at the ends, in lower case."""
    return F.lower(F.trim(text))


def is_plain_english(text: Column) -> Column:
    """X11: the whole text stays inside the allowed characters and is not blank; NULL is false.

    Gives the same answer before and after ``tidy``: that only trades allowed characters for
    allowed ones. So filters can test the raw column and tidy what is left.
    """
    foreign = F.when(_is_ascii(text), F.rlike(text, F.lit(f"[{FOREIGN_ASCII}]"))).otherwise(
        F.rlike(text, F.lit(f"[^{ALLOWED_CLASS}]"))
    )
    printed = F.rlike(text, F.lit(f"[^{BLANK_CLASS}]"))
    return F.coalesce(printed & ~foreign, F.lit(False))


def passes_english_filter(title: Column, summary: Column) -> Column:
    """X11 for an article: a title is needed, a missing summary passes, an empty one does not."""
    return is_plain_english(title) & (summary.isNull() | is_plain_english(summary))


def news_text(title: Column, summary: Column, clean: bool = False) -> Column:
    """``title. summary`` without trailing dots.

    Without a summary the text ends in ``". "`` because the blank shields the dot; ``clean``
    strips that tail too.
    """
    joined = F.rtrim(
        F.concat(title, F.lit(". "), F.coalesce(summary, F.lit(""))), F.lit(".")
    )
    return F.rtrim(joined, F.lit(". ")) if clean else joined


def classifier_text(title: Column, summary: Column) -> Column:
    """Title alone when there is no summary, else ``title. summary`` untouched."""
    head = F.coalesce(title, F.lit(""))
    tail = F.coalesce(summary, F.lit(""))
    return F.when(tail != "", F.concat(head, F.lit(". "), tail)).otherwise(head)


def parse_time(text: Column, pattern: str | None = None) -> Column:
    """Wall-clock time without zone; bad input becomes NULL."""
    if pattern is None:
        return F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def format_time(time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def calendar_date(time: Column) -> Column:
    """The day of a wall-clock time."""
    return F.to_date(time)


def prompt_text(template: str, ticker: Column, text: Column) -> Column:
    """A caller-supplied template with two ``%s`` places: ticker, then article text."""
    return F.format_string(template, ticker, F.coalesce(text, F.lit("")))
