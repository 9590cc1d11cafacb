"""Text functions as Columns; what is asked of whole files, line by line, is in lines.py."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE_CHARS = 300
QUESTION_TOKENS = 30.0

#: Words that may stand before a definition, and words that open one.
MODIFIERS = "export default public private protected internal static final abstract async unsafe extern inline virtual override const".split()
MACRO = "macro_rules!"
OPENERS = "def class fn func function impl struct enum trait interface type module mod namespace object record sub proc procedure package".split()

#: \b is spelled out: engines differ on letters beyond ASCII.
DEFINITION = rf"^\s*(?:(?:pub(?:\([a-z]+\))?|{'|'.join(MODIFIERS)})\s+)*(?:{MACRO}|(?:{'|'.join(OPENERS)})(?![0-9A-Za-z_]))"


def is_definition(line: Column) -> Column:
    return line.rlike(DEFINITION)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))


def blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def askable(line: Column) -> Column:
    return line.rlike("[A-Za-z0-9]")


def meaningful(line: Column) -> Column:
    return line.rlike(r"[\p{IsAlphabetic}\p{N}]")


def glob_regex(pattern: str) -> str:
    """An anchored regex for a shell pattern: * crosses /, an unterminated [ is a plain character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            end = pattern.find("]", j + 1)
            if end < 0:
                out.append(r"\[")
                continue
            items, k = [], j
            while k < end:
                if k + 2 < end and pattern[k + 1] == "-":
                    low, high = pattern[k], pattern[k + 2]
                    if low <= high:
                        items.append(f"{_escaped(low)}-{_escaped(high)}")
                    k += 3
                else:
                    items.append(_escaped(pattern[k]))
                    k += 1
            negated = j > i
            out.append(f"[{'^' if negated else ''}{''.join(items)}]" if items else ("." if negated else r"[^\x{0}-\x{10FFFF}]"))
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + ")$"


def _escaped(c: str) -> str:
    return "\\" + c if not c.isalnum() and c.isascii() else c


def path_matches(path: Column, patterns: list[str]) -> Column:
    """Whether the path, its last part or any tail behind a / matches one of the patterns."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    hit = F.lit(False)
    for p in patterns:
        whole = glob_regex(p)
        hit = hit | path.rlike(whole) | name.rlike(whole) | path.rlike(glob_regex("*/" + p))
    return hit


#: Characters of the Unicode property White_Space, as (?U)\s has them.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_glob(text: str, pattern: str) -> bool:
    """path_matches() of one pattern against a whole name, for the lister."""
    return bool(re.match(glob_regex(pattern).replace(r"\x{0}-\x{10FFFF}", "\\x00-\U0010ffff").replace("$", r"\Z") if "$" not in pattern else glob_regex(pattern)[:-1] + r"\Z", text))
