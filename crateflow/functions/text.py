"""String expressions shared by the catalogue queries (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key_a(c) -> Column:
    """Upper-case, then strip leading dots, then leading ', then leading ".

    Each character class is stripped once, in that order: ``."'x`` -> ``'X``.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.ltrim(F.ltrim(F.ltrim(F.upper(c), F.lit(".")), F.lit("'")), F.lit('"'))


def sort_key_b(c) -> Column:
    """Upper-case, then drop the *first* of . ' " wherever it is.

    ``A.B."C`` -> ``AB."C`` (a first-match replace, not a global one).
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.upper(c), r"""(?s)^([^.'"]*)[.'"]""", "$1")


def escape_like(text: str) -> str:
    """Escape LIKE wildcards so ``text`` matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test, ``ILIKE '%text%'``.

    By default ``%``, ``_`` and ``\\`` in ``text`` are literal; with
    ``wildcards=True`` they keep their LIKE meaning.
    """
    c = F.col(c) if isinstance(c, str) else c
    pat = text if wildcards else escape_like(text)
    return c.ilike(f"%{pat}%")


def canonical_list(arr: Column, sep: str = "|") -> Column:
    """Order-free text form of an array of strings: sorted, joined.

    Nested lists are compared this way between engines and in tests.
    """
    return F.array_join(F.array_sort(arr), sep)


def fmt_fields(*cols) -> Column:
    """``a:b:c`` of several columns, NULL rendered as empty."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str)
                              else F.coalesce(c.cast("string"), F.lit("")) for c in cols])
