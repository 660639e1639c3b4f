"""Text helpers that fold ASCII only, entity decoding, and glob patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Named entities and what they become in titles.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "-", "mdash": "--",
    "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "bull": "*", "hellip": "...", "copy": "(c)",
    "reg": "(R)", "trade": "(TM)", "laquo": "<<", "raquo": ">>", "deg": "deg", "plusmn": "+/-", "micro": "u",
    "para": "P", "middot": ".", "frac12": "1/2", "frac14": "1/4", "frac34": "3/4", "times": "x", "divide": "/",
}

_ENTITY = re.compile(r"&(?=[^;]{0,11};)(?:#[xX]([0-9a-fA-F]*)|#([0-9]*)|([^;#&][^;]*))?[^;]*;")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def contains_nocase(text: Column, part: str) -> Column:
    """Substring test that ignores the case of A-Z; the empty part is in every text."""
    return ascii_lower(text).contains(part.translate(str.maketrans(UPPER, LOWER)))


def decode_entities(text: str | None) -> str | None:
    """Named, decimal and hexadecimal entities, once; what is unknown or invalid stays."""
    if not text or "&" not in text:
        return text

    def one(m: re.Match) -> str:
        hexa, decimal, name = m.groups()
        if name is not None:
            return ENTITIES.get(name, m[0])
        digits, base = (hexa, 16) if hexa is not None else (decimal, 10)
        code = int(digits, base) if digits else 0
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    out, at = [], 0
    while (start := text.find("&", at)) >= 0:
        out.append(text[at:start])
        m = _ENTITY.match(text, start)
        piece = one(m) if m else "&"
        if m and piece == m[0]:  # unknown: only the sign is passed over
            piece, m = "&", None
        out.append(piece)
        at = m.end() if m else start + 1
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def html_decode(texts: pd.Series) -> pd.Series:
    return texts.map(decode_entities)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for * ? [abc] [a-z] [!x]; letters ignore case, classes don't.

    A class that is never closed ends with the pattern.
    """
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = pattern[i : i + 1] in ("!", "^") and i < len(pattern)
            i += negated
            parts = []
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i + 1 : i + 2] == "-" and pattern[i + 2 : i + 3] not in ("", "]"):
                    low, high = pattern[i], pattern[i + 2]
                    parts += [f"{_escaped(low)}-{_escaped(high)}"] if low <= high else []
                    i += 3
                else:
                    parts.append(_escaped(pattern[i]))
                    i += 1
            i += 1
            if parts:
                out.append(f"[{'^' if negated else ''}{''.join(parts)}]")
            else:
                out.append("." if negated else "(?!)")
        elif c.isascii() and c.isalpha():
            out.append(f"[{c.lower()}{c.upper()}]")
        else:
            out.append(_escaped(c))
    return "".join([*out, r"\z"])


def _escaped(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


#: POSIX classes and what they are in the engine's syntax (fixed values).
POSIX_CLASSES = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}",
    "space": r"\s", "blank": r"\p{Blank}", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}",
    "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}",
}


def posix_regex(pattern: str) -> str | None:
    """An extended POSIX pattern as an engine pattern that ignores case; None if it is not valid.

    In brackets a backslash is a plain character, and [:name:] a class.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                return None
            follow = pattern[i + 1]
            out.append("\\" + follow if not follow.isalnum() or follow in "wWsSbB" else re.escape(follow))
            i += 2
        elif c == "[":
            j = i + 1
            body = "["
            if pattern[j : j + 1] == "^":
                body += "^"
                j += 1
            first = True
            while j < n and (pattern[j] != "]" or first):
                first = False
                if pattern.startswith("[:", j):
                    end = pattern.find(":]", j)
                    name = pattern[j + 2 : end] if end > 0 else ""
                    if name not in POSIX_CLASSES:
                        return None
                    body += POSIX_CLASSES[name]
                    j = end + 2
                else:
                    body += pattern[j] if pattern[j].isalnum() or pattern[j] == "-" or ord(pattern[j]) > 127 else f"\\x{ord(pattern[j]):02x}"
                    j += 1
            if j >= n:
                return None
            out.append(body + "]")
            i = j + 1
        else:
            out.append(c)
            i += 1
    made = "".join(out)
    try:  # the same syntax as far as validity goes
        re.compile(re.sub(r"\\p\{\w+\}", "a", made))
    except re.error:
        return None
    return "(?i)" + made


def valid_utf8(c: Column) -> Column:
    """Whether the bytes of a text are UTF-8."""
    return F.is_valid_utf8(c)
