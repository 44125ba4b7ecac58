"""Literals and names as column expressions; only accent stripping needs Python (Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns: quoted body, language, datatype IRI, prefixed datatype; and what looks numeric.
LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^>]*)>|\^\^([A-Za-z]+:[^\s]+))?$'
NUMERIC = r"^[+-]*([0-9]+\.?[0-9]*|\.[0-9]+)$"
IRI_BASE = "http://openea.local"


def _unescaped(c: Column) -> Column:
    """Backslash escapes of the quoted form; \\\\ goes first, by way of a character that no text holds."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.contains("\\"), F.replace(out, F.lit("\x00"), F.lit("\\"))).otherwise(c)


def value(raw: Column) -> Column:
    """The value part; what is not a quoted literal is its own value."""
    body = _unescaped(F.regexp_extract(raw, LITERAL, 1))
    return F.when(raw.rlike(LITERAL) & ((body != "") | (raw == '""')), body).otherwise(raw)


def language(raw: Column) -> Column:
    return F.regexp_extract(raw, LITERAL, 2)


def local_name(uri: Column) -> Column:
    """After the last #, then after the last /."""
    return F.substring_index(F.substring_index(uri, "#", -1), "/", -1)


def namespace(uri: Column) -> Column:
    """Up to and with the last #, else the last /, else all of it."""
    return F.when(uri.contains("#"), F.regexp_extract(uri, r"(?s)^(.*#)", 1)).when(uri.contains("/"), F.regexp_extract(uri, r"(?s)^(.*/)", 1)).otherwise(uri)


def datatype(raw: Column) -> Column:
    """empty, langString, the datatype's local name, numeric or string."""
    iri, prefixed = F.regexp_extract(raw, LITERAL, 3), F.regexp_extract(raw, LITERAL, 4)
    return (
        F.when(raw == "", "empty")
        .when(language(raw) != "", "langString")
        .when(iri != "", local_name(iri))
        .when(prefixed != "", F.substring_index(prefixed, ":", -1))
        .when(value(raw).rlike(NUMERIC), "numeric")
        .otherwise("string")
    )


def is_ill_typed(raw: Column) -> Column:
    """Whether the lexical form breaks its XSD type (the types that a cast can judge)."""
    kind, v = datatype(raw), value(raw)
    whole = kind.isin("integer", "int", "long", "nonNegativeInteger", "positiveInteger")
    bad_int = whole & ~v.rlike(r"^[+-]?[0-9]+$") | (kind == "nonNegativeInteger") & v.rlike("^-[0-9]*[1-9]") | (kind == "positiveInteger") & ~v.rlike(r"^\+?[0-9]*[1-9][0-9]*$")
    bad_float = kind.isin("double", "float", "decimal") & v.try_cast("double").isNull()
    bad_date = (kind == "date") & (~v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}") | F.substring(v, 1, 10).try_cast("date").isNull())
    return F.coalesce(bad_int | bad_float | bad_date | (kind == "boolean") & ~v.isin("true", "false", "0", "1"), F.lit(False))


def strip_accents(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(strip_accents(t).lower().split()))


def normalised(raw: Column) -> Column:
    """Value part, accents stripped, lower case, runs of white space as one space."""
    return _folded(value(raw))


def normalised_ascii(raw: Column) -> Column:
    """The same without Python, for input known to be ASCII."""
    return F.trim(F.regexp_replace(F.lower(value(raw)), r"\s+", " "))


def folded_ascii(raw: Column) -> Column:
    """normalised() of what is ASCII, without Python: white space is what str.split() takes for it."""
    one = F.regexp_replace(F.lower(value(raw)), r"[\x09-\x0d\x1c-\x20]+", " ")
    return F.regexp_replace(one, "^ | $", "")


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit("([0-9a-z]+)"), F.lit(1))


def char_ngrams(normal: Column, n: int = 3) -> Column:
    """Sliding n-grams; a short text is one n-gram, an empty one none."""
    many = F.transform(F.sequence(F.lit(1), F.length(normal) - (n - 1)), lambda i: F.substring(normal, i, F.lit(n)))
    return F.when(F.length(normal) >= n, many).when(F.length(normal) > 0, F.array(normal)).otherwise(F.array().cast("array<string>"))


def to_iri(term: Column, kind: str) -> Column:
    """A reversible IRI: percent-encoded as RFC 3986 has it."""
    coded = F.url_encode(term)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"{IRI_BASE}/{kind}/"), coded)


def from_iri(iri: Column) -> Column:
    tail = F.regexp_extract(iri, rf"(?s)^{re.escape(IRI_BASE)}/[^/]*/(.*)$", 1)
    return F.when(iri.startswith(IRI_BASE + "/"), F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))).otherwise(iri)
