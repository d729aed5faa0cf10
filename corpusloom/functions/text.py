"""Text expressions. Character classes are spelled out so that they mean the same on the JVM as in Unicode Python."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as stripping and splitting understand it.
SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
#: Words and numbers of the lexical index: grouped digits with an optional percent sign, or runs of word characters.
TOKEN = "\\p{Nd}+(?:[.,]\\p{Nd}+)*%?|[\\p{L}\\p{N}_]+"
#: Symbols that carry no text in web pages.
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2B50}\\x{2B55}\\x{FE0F}]"
BLANKS = "[ \\t\\x{00A0}\\x{2009}\\x{202F}\\x{200B}\\x{FEFF}]+"


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no function for it. Pure ASCII batches cost one pass of C code."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return run(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rewrite(c: Column, *steps: tuple[str, str]) -> Column:
    """A chain of regular replacements."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


#: What a clean line is made by, in order.
TIDY = (
    (EMOJI, ""),
    ("[\\r\\n]", " "),
    (BLANKS, " "),
    (f"{SPACE}+([,.;:!?)])", "$1"),
    (f"\\({SPACE}+", "("),
    ('[”"“]{3,}', ""),
    (f"\\[{SPACE}*([^\\[\\]]*?\\(https?://[^)\\s]+\\)){SPACE}*\\]", "$1"),
)


def clean_text(c: Column, compose: bool = True) -> Column:
    """One clean line: no emoji, single blanks, tight punctuation, no stray quotes, links in brackets unwrapped."""
    return strip(rewrite(nfc(c) if compose else c, *TIDY))


def in_python(pattern: str) -> str:
    """A pattern of this module as Python's re reads it."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern.replace(SPACE, "\\s"))


def norm(c: Column, compose: bool = True) -> Column:
    """For comparing texts: composed, lower case, dashes alike."""
    return F.translate(F.lower(nfc(c) if compose else c), "–—", "--")


def has_any(c: Column, alternatives: Column) -> Column:
    """Whether text c holds one of an array of alternatives; both already went through norm()."""
    return F.exists(alternatives, lambda a: F.contains(c, a))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("document"))


def yaml_value(c: Column) -> Column:
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def decode_cf_email(c: Column) -> Column:
    """An address hidden as hex digits: the first byte is the key that each further byte was XORed with."""
    byte = lambda i: F.conv(F.substring(c, i, F.lit(2)), 16, 10).cast("int")
    at = F.when(F.length(c) >= 4, F.sequence(F.lit(3), F.length(c) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), "")


def tokens(c: Column, compose: bool = False) -> Column:
    """Words, then pairs of neighbouring words of which neither starts with a digit."""
    words = F.regexp_extract_all(F.lower(nfc(c) if compose else c), F.lit(TOKEN), F.lit(0))

    def with_pairs(w: Column) -> Column:
        left = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        pairs = F.zip_with(left, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(~(a.rlike("^\\p{Nd}") | b.rlike("^\\p{Nd}")), F.concat(a, F.lit("_"), b)))
        return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))

    # Bound once, so that words are extracted once.
    return F.element_at(F.transform(F.array(words), with_pairs), 1)


def title_of(url: Column, given_id: Column, title: Column) -> Column:
    """A document's id: the given one, else the last path part of its URL without ending, else its title; as a slug."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)/?$", 1), "(?<=.)\\.[^.]*$", "")
    return slugify(F.coalesce(F.nullif(given_id, F.lit("")), F.nullif(stem, F.lit("")), title, F.lit("")))


def page_metadata(row: Column, final_url: Column, title: Column, today: Column) -> Column:
    """Metadata of a fetched page as a map; row is a map of the columns of its manifest. Extra columns pass through if
    their names are plain."""
    empty = F.lit("")
    ident = title_of(final_url, row["doc_id"], title)
    fixed = F.create_map(
        F.lit("doc_id"),
        ident,
        F.lit("title"),
        F.coalesce(F.nullif(row["title"], empty), F.nullif(title, empty), F.initcap(F.replace(ident, F.lit("-"), F.lit(" ")))),
        F.lit("source_url"),
        final_url,
        F.lit("retrieved_at"),
        today,
        F.lit("document_version"),
        F.coalesce(F.nullif(row["document_version"], empty), F.lit("not-stated")),
    )
    known = ["url", "doc_id", "title", "document_version", "license_or_permission"]
    extra = F.map_filter(row, lambda k, v: ~k.isin(known) & (v != "") & k.rlike("^[a-z][a-z0-9_]*$"))
    return F.map_concat(fixed, extra)


def cache_key(*parts: Column) -> Column:
    """Key of a cached answer: hash of its parts, one to a line."""
    return F.sha2(F.concat_ws("\n", *parts), 256)
