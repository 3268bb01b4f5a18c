"""Person-identifier cleaning.

All functions return Column expressions built from Spark built-ins, so they
run inside whole-stage codegen.  Each cleaning step mentions its input at
most twice, so the expression stays small (no exponential tree growth when
the steps are nested).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

# The Unicode White_Space characters, trimmed from both ends.
WHITE_SPACE = ("\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Letters and punctuation are deleted from IDs.  Symbols such as "$" or "+"
# are not punctuation and stay (the id then fails the integer parse).
_ALPHA_OR_PUNCT = r"[\p{IsAlphabetic}\p{P}]"

# An id equal to this token after cleaning means "no id".
NULL_ID_TOKEN = "0000000000"


def trim_ws(c) -> Column:
    """Strip leading and trailing white space (all Unicode white space).

    Built-in ``trim`` with an explicit character set: no regex per row.
    """
    return F.trim(col_of(c), F.lit(WHITE_SPACE))


def normalize_id(c, width: int = 10) -> Column:
    """Clean a free-text person id to a ``width``-digit string or NULL.

    trim -> drop letters and punctuation -> blank is NULL -> keep the last
    ``width`` characters -> a shorter value is parsed as an integer (blanks
    around it and a leading ``+`` allowed) and zero-padded; one that does
    not parse, e.g. with an inner space, is NULL -> the all-zero id is NULL.

    The usual forms (digits, or digits with ASCII letters and hyphens before
    or after them) take one match and their digits; any other text takes the
    chain of steps, which gives the same for these forms too.
    """
    x = col_of(c)
    digits = F.when(x.rlike(_DIGITS), x).when(x.rlike(_MARKED_DIGITS), F.regexp_extract(x, _MARKED_DIGITS, 1)).otherwise(_id_text(x, width))
    return F.nullif(F.lpad(F.substring(digits, -width, width), width, "0"), F.lit("0" * width))


_DIGITS = r"^[0-9]+\z"
_MARKED_DIGITS = r"^ *[A-Za-z-]*([0-9]+)[A-Za-z-]* *\z"


def _id_text(x, width: int) -> Column:
    """The last ``width`` characters of an id of any form, or its integer digits, or ''.

    Written as a chain in which every step reads the previous one exactly
    once.  Catalyst inlines the expression wherever it pushes a filter on
    the id (even into a join condition); a step that mentioned its input
    several times would multiply the regex work per row.
    """
    stripped = F.regexp_replace(trim_ws(x), _ALPHA_OR_PUNCT, "")
    tail = F.substring(stripped, -width, width)  # last `width` characters, or all of a shorter value
    # a full-width value is kept as is; a shorter one keeps its integer digits;
    # anything else becomes '' and then the all-zero id
    return F.regexp_replace(tail, rf"(?s)^(?:(.{{{width}}})|\s*\+?([0-9]{{1,{width - 1}}})\s*|.*)$", "$1$2")


def normalize_id_by_steps(c, width: int = 10) -> Column:
    """``normalize_id`` by its steps alone, whatever the form."""
    return F.nullif(F.lpad(_id_text(col_of(c), width), width, "0"), F.lit("0" * width))


def pad_then_normalize(c, width: int = 10) -> Column:
    """Left-pad with zeros to ``width`` first (never truncating), then T1.

    Padding happens before trimming, so a leading blank stays inside the
    value (``" 12"`` -> ``"0000000 12"``), exactly as in the reference.
    """
    x = col_of(c)
    padded = F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)
    return normalize_id(padded, width)
