"""Text cleaning as native Column expressions.

Every step is a ``regexp_replace``/``replace`` chain that stays inside
whole-stage codegen; only the full HTML entity table (``html="full"``) needs a
vectorised Arrow UDF, for the references alone.  Order of steps is fixed:
html -> url -> mention -> hashtag -> repeats -> whitespace.

The character classes re-express Python ``re`` Unicode semantics for Java
regex (and for RE2, used by the SQL oracle):
  * whitespace = Python ``str.isspace`` set, written out explicitly
    (Java ``\\s`` is ASCII-only, RE2 ``\\s`` lacks ``\\x0B``);
  * word char = ``[\\p{L}\\p{N}_]`` (Java ``\\w`` is ASCII-only, Java ``(?U)\\w``
    also matches combining marks, which Python does not);
  * "any char but newline" = ``[^\\n]`` (Java ``.`` also excludes \\r, \\x85,
    \\u2028, \\u2029).
"""

from __future__ import annotations

import html as _html
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's cleaning rules)
URL_PLACEHOLDER = "<URL>"
USER_PLACEHOLDER = "<USER>"
# Python's whitespace set: \t \n \x0b \x0c \r \x1c-\x1f space \x85 and the
# Unicode separators (Zs, Zl, Zp).
WS_CLASS = r"\t\n\x0B\x0C\r\x1C-\x1F \x85\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"
URL_PATTERN = rf"(?i)https?://[^{WS_CLASS}]+|www\.[^{WS_CLASS}]+"
MENTION_PATTERN = r"@[A-Za-z0-9_]+"
HASHTAG_PATTERN = rf"#([{WORD_CLASS}]+)"
REPEAT_PATTERN = r"([^\n])\1{3,}"
WHITESPACE_PATTERN = rf"[{WS_CLASS}]+"
NON_SPACE_PATTERN = rf"[^{WS_CLASS}]"
# Basic HTML entity table for the native (codegen) decoder; "&amp;" must be
# decoded last so that "&amp;lt;" becomes "&lt;" as in a single-pass decoder.
HTML_BASIC_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&euro;", "€"),
    ("&pound;", "£"),
    ("&deg;", "°"),
    ("&amp;", "&"),
)
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def coerce_text(col: Column | str, null_as: str | None = None) -> Column:
    """Cast to string; NULL stays NULL unless ``null_as`` is given
    (``null_as="None"`` reproduces Python ``str(None)``)."""
    c = _c(col).cast("string")
    return c if null_as is None else F.coalesce(c, F.lit(null_as))


#: What the single-pass decoder of the standard library takes for a reference, in Java's syntax.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decoded(references: pa.Array) -> pa.Array:
    """Lists of references, each decoded; a distinct one is decoded once a batch."""
    flat = references.flatten().dictionary_encode()
    known = pa.array([_html.unescape(r) for r in flat.dictionary.to_pylist()], pa.string())
    sizes = np.diff(references.offsets.to_numpy())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), known.take(flat.indices))


def decode_html(col: Column | str, mode: str = "basic") -> Column:
    """HTML entities.  ``basic`` = native replace chain of common named
    entities (codegen, SQL-portable); ``full`` = complete HTML5 table incl.
    numeric references via an Arrow-batched UDF.  Only the references travel to
    Python and back; a text is split at them and put together again."""
    c = _c(col)
    if mode == "full":
        has, none = c.contains("&"), F.array().cast("array<string>")
        found = F.regexp_extract_all(c, F.lit(REFERENCE_PATTERN), 0)
        decoded = _decoded(F.coalesce(F.when(has, found), none))
        # one part more than references, the first in front of them
        parts = F.concat(F.array(F.lit("")), decoded)
        pieces = F.zip_with(parts, F.split(c, REFERENCE_PATTERN, -1), lambda a, b: F.concat(a, b))
        return F.when(has, F.array_join(pieces, "")).otherwise(c)
    if mode != "basic":
        raise ValueError(f"unknown html mode {mode!r}")
    decoded = c
    for ent, ch in HTML_BASIC_ENTITIES:
        decoded = F.replace(decoded, F.lit(ent), F.lit(ch))
    # Every entity starts with '&': one scan skips the replace chain for
    # texts without one (most of them).
    return F.when(c.contains("&"), decoded).otherwise(c)


def replace_urls(col: Column | str) -> Column:
    """URLs -> <URL> (case-insensitive scheme / www)."""
    return F.regexp_replace(_c(col), URL_PATTERN, URL_PLACEHOLDER)


def replace_mentions(col: Column | str) -> Column:
    """@name -> <USER> (also hits e-mail domains, as in the reference)."""
    return F.regexp_replace(_c(col), MENTION_PATTERN, USER_PLACEHOLDER)


def strip_hashtags(col: Column | str) -> Column:
    """C4: '#word' -> 'word'."""
    return F.regexp_replace(_c(col), HASHTAG_PATTERN, "$1")


def collapse_repeats(col: Column | str) -> Column:
    """Runs of 4+ equal characters -> 3."""
    return F.regexp_replace(_c(col), REPEAT_PATTERN, "$1$1$1")


def collapse_whitespace(col: Column | str) -> Column:
    """Whitespace runs -> one space, then strip the ends."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE_PATTERN, " "))


#: The steps of ``clean_col`` by name, in the order that they must have.
STEPS = {
    "entities": decode_html,
    "urls": replace_urls,
    "mentions": replace_mentions,
    "hashtags": strip_hashtags,
    "repeats": collapse_repeats,
    "spaces": collapse_whitespace,
}


def clean_col(col: Column | str, *, skip: Iterable[str] = (), html: str = "full", null_as: str | None = None) -> Column:
    """The cleaning chain as one Column, without the ``STEPS`` named in ``skip``."""
    left_out = set(skip)
    if unknown := left_out - STEPS.keys():
        raise ValueError(f"unknown cleaning steps: {sorted(unknown)}")
    options = {"entities": (html,)}
    text = coerce_text(col, null_as)
    for name in (n for n in STEPS if n not in left_out):
        text = STEPS[name](text, *options.get(name, ()))
    return text


def clean_df(df: DataFrame, column: str = "text", output: str | None = None, **flags) -> DataFrame:
    """Clean one column of ``df`` in place (or into ``output``), keeping all others."""
    return df.withColumn(output or column, clean_col(column, **flags))


def is_blank(col: Column | str) -> Column:
    """True when NULL or only whitespace (Python ``not s.strip()``)."""
    c = _c(col)
    return c.isNull() | ~c.rlike(NON_SPACE_PATTERN)
