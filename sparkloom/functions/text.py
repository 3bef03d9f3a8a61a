"""Native expressions over texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space inside a character class, in Java's and Python's regular expressions. Not \s, which differs in both.
WHITE = r"\t-\r \u0085   -     　"
#: The same characters as text.
WHITE_CHARS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITE}]")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def routing_extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without a dot or with nothing before it. Case is kept."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^[\s\S]+\.[^.]*$"), F.regexp_extract(name, r"\.([^.]*)$", 1))


def payload_extension(path: Column) -> Column:
    """What follows the last dot of the file name, also if nothing stands before it; empty without a dot."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.([^.]*)$", 1)


def file_uri(path: Column) -> Column:
    """A file URI with forward slashes; nothing is percent-encoded."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when((F.instr(p, ":/") == 0) & p.startswith("/"), F.concat(F.lit("file://"), p)).otherwise(F.concat(F.lit("file:///"), p))


def utf8_text(content: Column) -> tuple[Column, Column, Column]:
    """text, error_kind and error_message of file bytes: bytes that are no UTF-8 give an error and no text."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")), F.when(~valid, "invalid input"), F.when(~valid, "failed to read utf-8 file")


def point_id_errors(identifier: Column) -> Column:
    """An error message for an id that is blank, else null."""
    return F.when(F.coalesce(is_blank(identifier), F.lit(True)), "point id is empty")
