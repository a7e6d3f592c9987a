"""Text column functions: tokenisation, squeezing, token classes (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token = a CJK ideograph, an ASCII word, one space, or any other single character.
# Concatenating the tokens of a text gives the text back. Java and RE2 read it alike.
TOKEN_PATTERN = r"(?s)[\x{4e00}-\x{9fff}]|\w+| |."
# Word = a run of Unicode letters, digits or underscores; each CJK ideograph is a word of its own.
CJK_PATTERN = r"([\x{4e00}-\x{9fff}])"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """T4: ARRAY<STRING> of tokens whose concatenation equals ``text``."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def words(text: Column) -> Column:
    """Lower-cased words of any script; CJK ideographs one by one."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), CJK_PATTERN, " $1 "), F.lit(WORD_PATTERN), 0)


def squeeze(text: Column) -> Column:
    """Collapse runs of spaces to one and 3+ newlines to two."""
    return F.regexp_replace(F.regexp_replace(text, r" +", " "), r"\n{3,}", "\n\n")


def token_class(tok: Column) -> Column:
    """Coarse token class (re-aimed part-of-speech tag): cjk, num, word, space, newline, punct, other."""
    return (F.when(tok == " ", "space")
            .when(tok == "\n", "newline")
            .when(tok.rlike(r"^[\x{4e00}-\x{9fff}]$"), "cjk")
            .when(tok.rlike(r"^[0-9]+$"), "num")
            .when(tok.rlike(r"^\w+$"), "word")
            .when(tok.rlike(r"^[.,;:!?()\[\]{}-]$"), "punct")
            .otherwise("other"))


def char_len(text: Column) -> Column:
    """One token per character (the chunker's and chat memory's default)."""
    return F.length(text)
