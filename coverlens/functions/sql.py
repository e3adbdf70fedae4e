"""Helpers for writing Spark SQL expression text.

Large expressions (answer normalisation, grading) are written as Spark SQL
text and parsed once with ``F.expr``: one JVM call per stage instead of one
per function node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.strip()`` removes.
WS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def q(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    if "'" not in s and "\n" not in s:
        return "r'" + s + "'"
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return "'" + out + "'"


def strip(x: str, chars: str = WS) -> str:
    return f"btrim({x}, {q(chars)})"


def rep(x: str, old: str, new: str = "") -> str:
    """Literal replace of every occurrence."""
    return f"replace({x}, {q(old)}, {q(new)})"


def rx(x: str, pattern: str, replacement: str = "") -> str:
    """Java-regex replace of every match."""
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)})"


def after_first(x: str, delim: str) -> str:
    return f"substr({x}, instr({x}, {q(delim)}) + {len(delim)})"


def after_last(x: str, delim: str) -> str:
    return f"substring_index({x}, {q(delim)}, -1)"


def before_first(x: str, delim: str) -> str:
    return f"substring_index({x}, {q(delim)}, 1)"


def has(x: str, needle: str) -> str:
    return f"(instr({x}, {q(needle)}) > 0)"


def E(text: str) -> Column:
    return F.expr(text)


_let_counter = [0]


def let(bindings: dict[str, str], body) -> str:
    """Evaluate each binding once and use it by name inside ``body``.

    ``body`` is a function receiving a dict name -> SQL reference.  Written as
    ``element_at(transform(array(named_struct(...)), v -> body), 1)`` so large
    sub-expressions are not repeated in the expression tree.
    """
    _let_counter[0] += 1
    v = f"__let{_let_counter[0]}"
    fields = ", ".join(f"'{k}', {e}" for k, e in bindings.items())
    refs = {k: f"{v}.{k}" for k in bindings}
    return f"element_at(transform(array(named_struct({fields})), {v} -> {body(refs)}), 1)"
