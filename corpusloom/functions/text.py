"""Text clean-up and response post-processing, Column to Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BAD = "\ufffd"
_ESC = "\u001a"

# Markers of the prompt format.
BOS = "<s>"
EOS = "</s>"
INST_OPEN = "[INST]"
INST_CLOSE = "[/INST]"
CHAT_STOPS = (INST_CLOSE, EOS)
COMPLETION_STOPS = (EOS,)


def clean_utf8(text: Column) -> Column:
    """Drop bytes that are not valid UTF-8; valid strings pass untouched.

    ``make_valid_utf8`` marks bad bytes with U+FFFD. A genuine U+FFFD in the same
    string is escaped first, so that only the marks are removed.
    """
    guarded = F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "0")), F.lit(_BAD), F.lit(_ESC + "1"))
    dropped = F.replace(F.make_valid_utf8(guarded), F.lit(_BAD), F.lit(""))
    restored = F.replace(F.replace(dropped, F.lit(_ESC + "1"), F.lit(_BAD)), F.lit(_ESC + "0"), F.lit(_ESC))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def words(text: Column) -> Column:
    """Whitespace tokens, never empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def has_response(decoded: Column) -> Column:
    """Whether the last instruction segment contains the closing marker."""
    return F.contains(F.substring_index(decoded, INST_OPEN, -1), F.lit(INST_CLOSE))


def extract_response(decoded: Column) -> Column:
    """Answer after the closing marker of the last instruction, NULL without one."""
    last = F.substring_index(decoded, INST_OPEN, -1)
    answer = F.split_part(last, F.lit(INST_CLOSE), F.lit(2))
    return F.when(has_response(decoded), strip(F.replace(strip(answer), F.lit(EOS), F.lit(""))))


def response_status(decoded: Column) -> Column:
    return F.when(has_response(decoded), F.lit("ok")).otherwise(F.lit("no_marker"))


def cut_at_stop(text: Column, stops: Sequence[str] = CHAT_STOPS) -> Column:
    """Text before the first stop sequence."""
    pattern = "|".join(re.escape(s) for s in stops)
    return F.get(F.split(text, pattern, 2), F.lit(0))
