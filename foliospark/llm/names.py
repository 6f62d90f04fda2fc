"""Keys under which manifest entries name the same document, author or file."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Full-width signs U+FF01..U+FF5E stand 0xFEE0 above their plain forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

# Ways in which a source says that an author is not known.
NOT_KNOWN = frozenset(
    [
        "unknown", "notknown", "unknownauthor", "authorunknown", "notstated", "notgiven", "notavailable",
        "anonymous", "anon", "na", "none", "null", "nil", "nan", "tbd", "noauthor", "unbekannt", "anonym",
        "inconnu", "anonyme", "desconocido", "anonimo", "anónimo", "kangabe", "ohneangabe", "sinautor", "unspecified",
        "undisclosed", "withheld", "various",
    ]
)

# Digests of empty input (MD5, SHA-1, SHA-256).
EMPTY_DIGESTS = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


def narrow(c: Column) -> Column:
    """``c`` with full-width signs and the wide blank in their plain form."""
    return F.translate(c, _WIDE + "　", _PLAIN + " ")


def document_key(c: Column) -> Column:
    """The document a name stands for, or null if it names none.

    Letter case, width, blanks, separators, folder, file ending and a page at the end
    (``-p0012``, ``page 3``) are ignored.
    """
    name = F.lower(narrow(c))
    name = F.regexp_replace(name, r"[\s\p{Z}\p{Cf}]+", "")
    name = F.regexp_replace(name, r"^.*[/\\]", "")
    name = F.regexp_replace(name, r"(\.(pdf|docx?|xlsx?|pptx?|html?|txt|md|xml|epub|tiff?|gz|zip))+$", "")
    name = F.regexp_replace(name, r"[-_.#,;:]+(p|pg|page|s|seite)[-_.=]?[0-9]{1,5}$", "")
    name = F.regexp_replace(name, r"[^\p{L}\p{N}]+", "")
    return F.when(name != "", name)


def digest_key(c: Column) -> Column:
    """A file digest in one writing; null if it is none or stands for no file at all."""
    plain = c.rlike(r"\A[0-9a-f]{32,128}\z")  # the common writing needs no work
    d = F.lower(F.regexp_replace(narrow(c), r"[\s\p{Z}\p{Cf}]+", ""))
    d = F.regexp_replace(d, r"^(sha-?(1|256|512)|md5)?[:=]?(0x)?", "")
    d = F.when(plain, c).otherwise(F.regexp_replace(d, r"[-:]", ""))
    real = d.rlike("^[0-9a-f]{32,128}$") & ~d.rlike(r"^(.)\1+$") & ~d.isin(*EMPTY_DIGESTS)
    return F.when(real, d)


def author_name(text: str | None) -> str | None:
    """The key of one author, or None if the field names nobody."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKC", text).casefold()
    parts = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain))
    if not parts or "".join(parts) in NOT_KNOWN:
        return None
    return " ".join(sorted(parts))


@F.pandas_udf(StringType())
def author_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Authors by name, whatever the case, blanks, accent encoding or order of the names."""
    for batch in batches:
        yield batch.map(author_name, na_action=None)
