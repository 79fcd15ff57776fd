"""String helpers shared by both rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.fixed_values import MAX_SNIPPET_CHARS, WHITESPACE

#: Letters outside a-z that match i, s or k when case is ignored.
ODD_LETTERS = "\u0130\u0131\u017f\u212a"

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
ASCII_WORD = "A-Za-z0-9_"


def to_java(pattern: str, first: str = "", value: str = "(", starts_with_word: bool = True,
            ascii_only: bool = False) -> str:
    """Express a published pattern so that Spark's regex functions match the same text.

    Character classes become Unicode-wide, only a newline ends a line, and the named value group
    opens with ``value``. ``first`` names the characters a match can start with; testing them
    ahead spares the look behind at every other place. A boundary in front of a pattern that can
    only start with a word character needs no more than that look behind. ``ascii_only`` gives
    the narrow classes, which match the same in pure ASCII text and run faster.
    """
    word = ASCII_WORD if ascii_only else WORD
    flags = "d" if ascii_only else "Ud"
    if pattern.startswith("(?i)") or pattern.startswith("(?m)") or pattern.startswith("(?im)"):
        given, pattern = pattern[2:].split(")", 1)
        flags += given
    lead = f"(?=[{first}])" if first else ""
    if starts_with_word and pattern.startswith(r"\b"):
        lead, pattern = rf"{lead}(?<![{word}])", pattern[2:]
    pattern = pattern.replace("(?P<val>", value)
    edge = rf"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two == r"\w":
            out.append(word if in_class else f"[{word}]")
        elif two == r"\b":
            out.append(edge)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return f"(?{flags}){lead}" + "".join(out)


def linear_email(pattern: str) -> str:
    """The mail pattern in linear time: a run of address characters is tried once, not at each
    of its places, because the ``@`` behind it is the same from all of them."""
    local, rest = pattern.split("+@", 1)
    return rf"(?:\G|(?<!{local})){local}++@{rest}"


def java_email(pattern: str) -> str:
    return "(?d)" + linear_email(pattern)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"(?U)[^{SPACE}]")


def has_odd_letters(text: Column) -> Column:
    """Whether lower-casing may hide a label that a case-blind pattern would still match."""
    return text.rlike(f"[{ODD_LETTERS}]")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def digits_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\D", ""))


def has_digit(c: Column) -> Column:
    return c.rlike(r"(?U)\d")


def is_usable(snippet: Column) -> Column:
    """The gate every snippet passes: 1 to 200 characters with an ASCII letter or digit."""
    return F.length(snippet).between(1, MAX_SNIPPET_CHARS) & snippet.rlike("[A-Za-z0-9]")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """Lower-cased extension with its dot; a leading or trailing dot makes no extension."""
    return F.lower(F.regexp_extract(name, r"(?s)[^/.][^/]*(\.[^./]+)$", 1))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated once per row.

    The optimizer copies a projected expression into every later filter on it, which would run the
    patterns again. It never does so with the output of a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def jvm_of(df: DataFrame) -> object:
    """Key for columns kept between plans: they belong to the JVM they were built in."""
    return df.sparkSession.sparkContext._jvm
