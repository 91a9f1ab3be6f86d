"""Text columns: trimming, lengths, previews, text-to-number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript's String.trim() removes.
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_text(c: Column) -> Column:
    """Strip leading and trailing JavaScript whitespace.

    ``btrim`` is linear in the text; an anchored regex rescans every inner run of blanks.
    """
    return F.btrim(c, F.lit(JS_WHITESPACE))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def longer_than(c: Column, units: int) -> Column:
    """``utf16_length(c) > units`` without encoding texts that are clearly short or long.

    The UTF-16 length lies between the character count and the UTF-8 byte count.
    """
    return (F.octet_length(c) > units) & ((F.char_length(c) > units) | (utf16_length(c) > units))


def content_preview(c: Column, chars: int = 80) -> Column:
    """The first ``chars`` characters, with an ellipsis when the text is longer."""
    return F.when(F.char_length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def id_prefix(c: Column, chars: int = 8) -> Column:
    """The first ``chars`` characters of an id and an ellipsis."""
    return F.concat(F.substring(c, 1, chars), F.lit("…"))


def js_number(c: Column) -> Column:
    """Text to double as JavaScript's ``Number(text)`` reads it; NaN when it is no number."""
    t = trim_text(c)
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))

    def radix(base: int) -> Column:
        # Digits are summed up as a double: any number of them, without overflow.
        digits = F.filter(F.split(F.lower(F.substr(t, F.lit(3))), ""), lambda d: d != "")
        return F.aggregate(digits, F.lit(0.0), lambda n, d: n * base + F.instr(F.lit("123456789abcdef"), d))

    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(t == "", F.lit(0.0))
        .when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
        .when(t.rlike(r"^[+-]?Infinity$"), sign * F.lit(float("inf")))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), radix(16))
        .when(t.rlike(r"^0[oO][0-7]+$"), radix(8))
        .when(t.rlike(r"^0[bB][01]+$"), radix(2))
        .otherwise(F.lit(float("nan")))
    )
