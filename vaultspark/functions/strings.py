"""String expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark import lexicons as L


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern with Unicode classes and \\n as the only line end; flags: i, m, s."""
    return f"(?{flags}Ud){pattern}"


#: Unicode's white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def filled(c: Column) -> Column:
    """Null for a text that is empty or blank."""
    return F.nullif(strip(c), F.lit(""))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def lookup(key: Column, table: Mapping, default) -> Column:
    """A value by key, or the default."""
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(entries, key), F.lit(default))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    found = F.lit(False)
    for w in words:
        found |= F.contains(c, F.lit(w))
    return found


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of more than one character, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))


def word_set(c: Column) -> Column:
    """Distinct runs of a-z and 0-9, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def holds_all(part: Column, whole: Column) -> Column:
    """Whether part has words and whole has all of them."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(c, F.lit(rx(r"\S+")), F.lit(0))


def is_garbage(c: Column) -> Column:
    """No words, or more than half of them of one or two characters."""
    found = words(c)
    return (F.size(found) == 0) | (F.size(F.filter(found, lambda t: F.length(t) <= 2)) / F.size(found) > 0.5)


def split_pipe(c: Column) -> Column:
    """The filled parts of a text with bars between them."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")


def year(c: Column) -> Column:
    """The first four-digit year of the 1900s or 2000s, or null."""
    return first_match(c, rx(L.YEAR))


def without_bom(c: Column) -> Column:
    """Without byte order marks at the start."""
    return F.regexp_replace(c, "^﻿+", "")


def allergens(text: Column) -> Column:
    """Allergens named in a text; one fixed label if it says that none is known."""
    named = F.transform(F.regexp_extract_all(text, F.lit(rx(L.ALLERGY, "i")), F.lit(1)), lambda x: F.rtrim(strip(x), F.lit(".,;")))
    none = F.coalesce(text, F.lit("")) == ""
    return F.when(none, F.array().cast("array<string>")).when(text.rlike(rx(L.NO_ALLERGY, "i")), F.array(F.lit(L.NO_ALLERGY_LABEL))).otherwise(F.filter(named, lambda x: F.length(x) > 2))


def exploded(rows: DataFrame, column: str, at: str, to: str) -> DataFrame:
    """A row per element. The outer form: for the inner one Catalyst infers a filter on the array's size and computes the array twice."""
    return rows.select("*", F.posexplode_outer(column).alias(at, to)).filter(F.col(at).isNotNull())


def escaped(c: Column) -> Column:
    """Safe inside HTML; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def attribute(c: Column) -> Column:
    """A JSON string literal, safe inside a quoted HTML attribute."""
    listed = F.to_json(F.array(c))
    return escaped(F.substring(listed, F.lit(2), F.length(listed) - 2))


def initials(name: Column) -> Column:
    """The first characters of the first two words that have any."""
    return F.substring(F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), ""), 1, 2)


def countdown(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; a fixed phrase once the time has come."""
    whole = F.floor(seconds + 0.5)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, sec = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(whole <= 0, "Any moment now").when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec))).otherwise(F.concat_ws(":", m.cast("string"), two(sec)))


@F.pandas_udf(T.StringType())
def password_hash(password: pd.Series, salt: pd.Series) -> pd.Series:
    """PBKDF2 with SHA-256 and 100,000 rounds, in hexadecimal."""
    return pd.Series([hashlib.pbkdf2_hmac("sha256", p.encode(), x.encode(), 100_000).hex() for p, x in zip(password, salt, strict=True)], index=password.index)
