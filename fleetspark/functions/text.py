"""String rewrites in the sed / shell-expansion dialects the fleet scripts use.

F1 replace all, F2 replace first, F3 replace on addressed lines, F4 capture
groups, F8 strip up to the first space, F9 basename, F10 strip last dotted part,
F11 join with separator, F12 URI fragment, F13 split + index.  All are Spark
expressions; first-only replacement never uses numbered group references (a
``$1`` followed by a digit is ambiguous in Java replacement strings).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(s, find: str, repl: str) -> Column:
    """``s/find/repl/g`` with a literal ``find`` (F1)."""
    return F.replace(_c(s), F.lit(find), F.lit(repl))


def regex_replace_all(s, pattern: str, repl: str) -> Column:
    """``s/pattern/repl/g`` with a Java regex (F1); ``repl`` in Java syntax."""
    return F.regexp_replace(_c(s), pattern, repl)


def replace_first(s, find: str, repl: str) -> Column:
    """``s/find/repl/`` with a literal ``find``: only the first occurrence (F2).

    Built from ``instr`` and two substrings so no regex or group reference is
    involved.
    """
    s = _c(s)
    if not find:
        return s
    pos = F.instr(s, find)
    head = F.substr(s, F.lit(1), pos - F.lit(1))
    tail = F.substr(s, pos + F.lit(len(find)))
    return F.when(pos > 0, F.concat(head, F.lit(repl), tail)).otherwise(s)


def _java_literal_repl(repl: str) -> str:
    return repl.replace("\\", "\\\\").replace("$", "\\$")


def regex_replace_first(s, pattern: str, repl: str) -> Column:
    """``s/pattern/repl/`` (first match only) with a Java regex and a literal ``repl``.

    The lazy prefix is kept through a *named* group so the replacement never
    contains a numbered reference.
    """
    wrapped = "^(?s)(?<fspre>.*?)(?:" + _shift_references(pattern, "\\", 1) + ")"
    return F.regexp_replace(_c(s), wrapped, "${fspre}" + _java_literal_repl(repl))


def addressed(s, address: str, edit) -> Column:
    """``/address/ edit``: apply ``edit`` (a function of the column) only on matching lines."""
    s = _c(s)
    return F.when(s.rlike(address), edit(s)).otherwise(s)


def sed_to_java_replacement(repl: str) -> str:
    """Translate a sed replacement (``\\1``, ``&``) into Java syntax.

    A group reference directly followed by a digit cannot be expressed with
    numbered groups in Java and is rejected.
    """
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            if nxt.isdigit():
                if i + 2 < len(repl) and repl[i + 2].isdigit():
                    raise ValueError("group reference followed by a digit: " + repl)
                out.append("$" + nxt)
            else:
                out.append(_java_literal_repl(nxt))
            i += 2
            continue
        if ch == "&":
            out.append("$0")
        else:
            out.append(_java_literal_repl(ch))
        i += 1
    return "".join(out)


def capture_replace(s, pattern: str, sed_repl: str, global_: bool = False) -> Column:
    """``s/(..)/\\1../`` with capture groups (F4).  First match unless ``global_``."""
    java = sed_to_java_replacement(sed_repl)
    if global_ or pattern.startswith("^"):
        return F.regexp_replace(_c(s), pattern, java)
    # first match only: group 1 is what stands before it, group 2 the match (``&``), the pattern's own follow
    return F.regexp_replace(_c(s), "^(?s)(.*?)(" + _shift_references(pattern, "\\", 2) + ")",
                            "$1" + _shift_references(java, "$", 2))


def _shift_references(text: str, mark: str, by: int) -> str:
    """Add ``by`` to the group references of a Java pattern (``\\1``) or replacement (``$0``); escapes stay."""
    out, i = [], 0
    while i < len(text):
        pair = text[i:i + 2]
        if pair[0] == mark and pair[1:].isdigit() and (mark == "$" or pair[1] != "0"):
            out.append(mark + str(int(pair[1]) + by))
        elif pair[0] == "\\":
            out.append(pair)
        else:
            out.append(pair[0])
            i -= 1
        i += 2
    return "".join(out)


def strip_to_first_space(s) -> Column:
    """``${var#* }``: drop the shortest prefix ending in a space; unchanged without one (F8)."""
    return F.regexp_replace(_c(s), "^[^ ]* ", "")


def basename(s, suffix: str | None = None) -> Column:
    """``basename PATH [SUFFIX]`` (F9): trailing slashes ignored, suffix removed unless it is the whole name."""
    s = _c(s)
    trimmed = F.regexp_replace(s, "/+$", "")
    base = F.when((trimmed == "") & (F.length(s) > 0), F.lit("/")).otherwise(
        F.substring_index(trimmed, "/", -1))
    if not suffix:
        return base
    return F.when(base.endswith(suffix) & (base != F.lit(suffix)),
                  F.substr(base, F.lit(1), F.length(base) - F.lit(len(suffix)))).otherwise(base)


def strip_last_dotted(s) -> Column:
    """``s/.[0-9][0-9]*$//g`` with the dot unescaped, as written."""
    return F.regexp_replace(_c(s), ".[0-9][0-9]*$", "")


def join_ws(sep: str, *cols) -> Column:
    """``${A}-${B}-${C}`` (F11); nulls are skipped like empty shell variables."""
    return F.concat_ws(sep, *[_c(c) for c in cols])


def uri_fragment(uri) -> Column:
    """Name after ``#`` with percent / plus decoding (F12); null when there is no fragment."""
    uri = _c(uri)
    return F.when(F.instr(uri, "#") > 0, F.try_url_decode(F.substring_index(uri, "#", -1)))


def split_get(s, sep_regex: str, index: int) -> Column:
    """Split and take element ``index`` (0-based, null when short)."""
    return F.get(F.split(_c(s), sep_regex), index)


def split_size(s, sep_regex: str = r"\s+") -> Column:
    """List length as a count (A6), words parted by any run of white space; an empty string has no elements."""
    s = _c(s)
    return F.when(F.trim(s) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(s), sep_regex)))


def awk_field(line, n: int) -> Column:
    """awk ``$n`` (1-based) of a whitespace-separated line."""
    return F.get(F.split(F.trim(_c(line)), r"\s+"), n - 1)


def lines_array(text) -> Column:
    """Split a text into its lines; a final newline does not start an empty line."""
    text = _c(text)
    arr = F.split(text, "\n")
    return F.when(text.endswith("\n"), F.slice(arr, F.lit(1), F.size(arr) - F.lit(1))).otherwise(arr)
