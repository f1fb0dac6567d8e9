"""Text functions whose details matter: case, patterns, lines, paths, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of the 26 letters only; other letters keep their case."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_lower_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def escape_like(s: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", s)


def contains_nocase(c: Column, needle: str) -> Column:
    """The needle literally, in either ASCII case; null columns do not contain it."""
    return F.coalesce(F.contains(ascii_lower(c), F.lit(ascii_lower_text(needle))), F.lit(False))


def startswith_nocase(c: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(ascii_lower(c), F.lit(ascii_lower_text(prefix))), F.lit(False))


def equals_nocase(c: Column, other: str) -> Column:
    return F.coalesce(ascii_lower(c) == F.lit(ascii_lower_text(other)), F.lit(False))


def lines(c: Column) -> Column:
    """Lines without their ends: one final empty line is none, one carriage return before the end goes."""
    parts = F.split(c, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def percent_encoded(c: Column) -> Column:
    """Bytes other than letters, digits and - . _ ~ / as % and two upper-case digits."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), percent_encoded(F.replace(path, F.lit("\\"), F.lit("/"))))


def relative_path(path: Column, root: Column) -> Column:
    """path below root with forward slashes; a path elsewhere stays whole."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    below = F.concat(r, F.lit("/"))
    return F.when(F.startswith(p, below), F.substr(p, F.length(below) + 1)).otherwise(p)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last component, '' if it has none; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def _language(ext: Column, known: dict[str, tuple[str, ...]]) -> Column:
    out = F.when(F.lit(False), "")
    for language, extensions in known.items():
        out = out.when(ext.isin(*extensions), language)
    return out.otherwise("other")


#: Extensions of the languages of full-text documents and of source files.
FTS_LANGUAGES = {"rust": ("rs",), "csharp": ("cs",), "markdown": ("md", "markdown", "mdx")}
SOURCE_LANGUAGES = {"rust": ("rs",), "csharp": ("cs", "csx"), "markdown": ("md", "markdown", "mdx")}


def fts_language(path: Column) -> Column:
    return _language(extension(path), FTS_LANGUAGES)


def source_language(path: Column) -> Column:
    return _language(extension(path), SOURCE_LANGUAGES)


def linked_language(path: Column) -> Column:
    """By case-sensitive ending; a missing path is unknown."""
    return (
        F.when(path.isNull(), "unknown").when(F.endswith(path, F.lit(".rs")), "rust").when(F.endswith(path, F.lit(".cs")), "csharp")
        .when(F.endswith(path, F.lit(".md")) | F.endswith(path, F.lit(".markdown")), "markdown").otherwise("other")
    )


def is_markdown(path: Column) -> Column:
    p = ascii_lower(path)
    return F.coalesce(F.endswith(p, F.lit(".md")) | F.endswith(p, F.lit(".markdown")), F.lit(False))


def sanitized(c: Column) -> Column:
    """Control characters other than tab and line ends as blanks."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " ")
