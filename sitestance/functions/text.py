"""Text expressions: byte decoding, control-aware trimming, character references."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitestance.config import CHARSETS, ENTITIES

# A line ends at any of these.
LINE_BREAKS = "[\n\r\u0085\u2028\u2029]"

_REFERENCE = r"&(?:#0*[0-9]{1,8}|#[xX]0*[0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def constant(data: dict | list, schema: str) -> Column:
    """Plain data as a literal; the optimizer folds the reading of it away."""
    return F.from_json(F.lit(json.dumps(data)), schema)


def control_trim(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends; ``trim`` strips spaces only."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def declared_charset(content: Column, content_type: Column) -> Column:
    """The character set named by the header, else by a meta tag in the first 1,024 bytes."""
    def named(where: Column) -> Column:
        found = F.regexp_extract(where, r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)", 1)
        return F.lower(F.nullif(found, F.lit("")))

    start = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    tag = F.regexp_extract(start, r"(?i)<meta\b[^>]{0,1000}?charset[^>]{0,1000}", 0)
    return F.coalesce(named(content_type), named(tag))


def decode_page(content: Column, content_type: Column) -> Column:
    """Bytes of a page to text: byte order mark, header, meta tag, else UTF-8.

    Unknown character sets count as UTF-8; null content gives null.
    """
    known = F.try_element_at(constant(CHARSETS, "map<string,string>"), declared_charset(content, content_type))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") | (
        F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    )
    return F.when(marked | known.isNull(), decode_text(content)).otherwise(
        F.call_function("decode", content, known)
    )


def decode_text(content: Column) -> Column:
    """Bytes to text: the byte order mark picks the charset, UTF-8 otherwise.

    The mark is removed and malformed bytes become U+FFFD (the UTF-16 branches
    need the setting made by ``session.prepare``).
    """
    head2 = F.hex(F.substring(content, 1, 2))
    head3 = F.hex(F.substring(content, 1, 3))
    tail2 = content.substr(F.lit(3), F.octet_length(content))
    tail3 = content.substr(F.lit(4), F.octet_length(content))
    return (
        F.when(head3 == "EFBBBF", F.make_valid_utf8(tail3.cast("string")))
        .when(head2 == "FFFE", F.decode(tail2, "UTF-16LE"))
        .when(head2 == "FEFF", F.decode(tail2, "UTF-16BE"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def decode_references(text: Column) -> Column:
    """Replace HTML character references; unknown ones stay as written."""
    names = constant(ENTITIES, "map<string,string>")

    def from_code(code: Column, raw: Column) -> Column:
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        padded = F.lpad(F.hex(F.when(usable, code).otherwise(F.lit(0xFFFD))), 8, "0")
        return F.when(code.isNotNull(), F.decode(F.unhex(padded), "UTF-32")).otherwise(raw)

    def one(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        return (
            F.when(~F.startswith(token, F.lit("&")) | (token == "&"), token)
            .when(
                token.rlike(r"^&#[xX]"),
                from_code(F.conv(digits, 16, 10).try_cast("bigint"), token),
            )
            .when(F.startswith(token, F.lit("&#")), from_code(digits.try_cast("bigint"), token))
            .otherwise(
                F.coalesce(
                    F.try_element_at(names, F.regexp_extract(token, r"^&([A-Za-z0-9]+);$", 1)),
                    token,
                )
            )
        )

    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, one), "")).otherwise(
        text
    )
