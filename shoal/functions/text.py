"""Text cleaning and tokenising as column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, written so that Java and RE2 regular expressions agree on it.
SPACES = r"[\s\x0b\p{Z}\x1c-\x1f\x85]+"
# A word character is a letter, a digit or an underscore of any script; a token has at least two.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Words of the collocation report: a word character followed by word characters or apostrophes.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"

# The entities that markup of plain prose uses; numeric references are decoded by rule.
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACES, " "))


def strip_markup(col: Column) -> Column:
    """Tags become spaces, white space is collapsed; null becomes the empty string."""
    text = F.coalesce(col, F.lit(""))
    return collapse_spaces(F.regexp_replace(text, "<[^>]+>", " "))


def strip_markup_and_code_spans(col: Column) -> Column:
    """`strip_markup` that also drops fenced blocks and inline back-tick spans."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", " ")
    text = F.regexp_replace(text, "(?s)```.*?```", " ")
    return collapse_spaces(F.regexp_replace(text, "`[^`]*`", " "))


def decode_entities(col: Column) -> Column:
    """Decode character references in one pass, so that `&amp;lt;` gives `&lt;`."""

    def decode(token: Column) -> Column:
        number = F.when(
            token.rlike("^&#[xX]"), F.conv(F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
        ).otherwise(F.regexp_extract(token, "^&#([0-9]+);$", 1))
        out = F.when(
            token.rlike("^&#([0-9]{1,6}|[xX][0-9a-fA-F]{1,5});$"),
            F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"),
        )
        for name, char in NAMED_ENTITIES.items():
            out = out.when(token == f"&{name};", F.lit(char))
        return out.otherwise(token)

    tokens = F.regexp_extract_all(col, F.lit(r"(&#?[0-9a-zA-Z]+;|[^&]+|&)"), F.lit(1))
    return F.when(F.instr(col, "&") > 0, F.array_join(F.transform(tokens, decode), "")).otherwise(col)


def strip_markup_dropping_code(col: Column) -> Column:
    """Visible text of a page without code: comments, scripts, styles, `code` and `pre` go with their contents."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), "(?s)<!--.*?-->", "")
    for tag in ("script", "style", "code", "pre"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, "<[^>]+>", "")
    return collapse_spaces(decode_entities(text))


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def tokens(col: Column, stop_words: list[str]) -> Column:
    """Lower-cased tokens of at least two word characters, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams with low <= n <= high, words joined by one space.

    Each word is zipped with the words after it, so the work is linear in the number of words.
    """
    size = F.size(words)
    shifted = F.arrays_zip(*[F.slice(words, i + 1, size).alias(f"w{i}") for i in range(high)])

    def starting_here(z: Column) -> Column:
        grams = [
            F.when(z[f"w{n - 1}"].isNotNull(), F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)]))
            for n in range(low, high + 1)
        ]
        return F.array_compact(F.array(*grams))

    return F.flatten(F.transform(shifted, starting_here))
