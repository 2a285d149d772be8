"""Text functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where sentences end, the shortest that counts, and the longest comment that
# an embedder takes.
SENTENCE_BREAK = r"\. |\? |! "
SHORTEST_SENTENCE = 3
LONGEST_COMMENT = 511

WHITE_SPACE = string.whitespace


def split_sentences(text: Column) -> Column:
    """Pieces between ``'. '``, ``'? '`` and ``'! '`` that have at least three characters."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.length(s) >= SHORTEST_SENTENCE)


def ascii_lower(text: Column) -> Column:
    """Lower-case the 26 ASCII letters only; ``É`` stays ``É``."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def truncate(text: Column, length: int = LONGEST_COMMENT) -> Column:
    """The first ``length`` characters (code points)."""
    return F.substring(text, 1, length)


def join_pieces(pieces: Column) -> Column:
    """Translated pieces joined by a blank, without white space at the ends."""
    return F.btrim(F.array_join(pieces, " "), F.lit(WHITE_SPACE))


def ordered_distinct_join(pieces: Column) -> Column:
    """The first occurrence of each piece, joined by a blank."""
    return F.array_join(F.array_distinct(pieces), " ")


def seconds_of(duration: Column) -> Column:
    """``'12.3s'`` as a number of seconds."""
    return F.regexp_extract(duration, r"^(\d+(?:\.\d+)?)s$", 1).try_cast("double")
