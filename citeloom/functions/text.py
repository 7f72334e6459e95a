"""Column expressions over strings: names, slugs, headings, content words, identities. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that nearly every clause holds, so that sharing them says nothing.
STOPWORDS = (
    "the and for that with this from will shall must should may any all not are was were been being have has had its "
    "their they them which when where who whom such other than then there these those upon under over into onto out off "
    "each every both either neither about after before during within without accordance applicable appropriate required "
    "requirement requirements ensure ensures provide provides provided including include includes issuance department "
    "defense dod component components section subsection paragraph"
).split()

# Patterns and limits that identities and results depend on.
SLUG_LIMIT, SLUG_FALLBACK = 80, "document"
WORD = r"[a-z][a-z\-]{2,}"
DESIGNATOR = r"(?U)\bDoD[DIM]\s+[0-9][0-9.\-]*[A-Z]?\b"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)\.\s+\S"
NAMED_HEADING = r"^(CHAPTER|SECTION|APPENDIX|ENCLOSURE)\s+([\dIVXA-Z]+)\b"
DOT_LEADER = r"\.\s?\.\s?\.\s?\."
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def casefold(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def base_slug(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, trimmed, cut, trimmed again."""
    dashed = F.regexp_replace(casefold(name), "[^a-z0-9]+", "-")
    cut = F.substring(F.btrim(dashed, F.lit("-")), 1, SLUG_LIMIT)
    slug = F.btrim(cut, F.lit("-"))
    return F.when(slug == "", SLUG_FALLBACK).otherwise(slug)


def hash_suffix(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 8)


def suffixed(slug: Column, name: Column) -> Column:
    return F.concat_ws("-", slug, hash_suffix(name))


def canonical_name(name: Column) -> Column:
    """What two spellings of a name have in common: no bracketed parts, lower case, letters and digits only."""
    return F.regexp_replace(casefold(F.regexp_replace(name, r"\([^)]*\)", "")), "[^a-z0-9]", "")


def squeeze(text: Column) -> Column:
    """Runs of white space, of any script, as one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    return casefold(squeeze(text))


def _identity(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def path_text(path: Column) -> Column:
    return F.array_join(path, "/")


def obligation_id(version_id: Column, path: Column, statement: Column) -> Column:
    return _identity(version_id, path_text(path), normalized(statement))


def chunk_id(version_id: Column, path: Column, occurrence: Column, part: Column) -> Column:
    return _identity(version_id, path_text(path), occurrence.cast("string"), part.cast("string"))


def decision_key(source: Column, target: Column) -> Column:
    """Directional: the key of (a, b) is not that of (b, a)."""
    return _identity(source, target)


def change_id(before: Column, after: Column, kind: Column, obligation: Column) -> Column:
    return _identity(before, after, kind, obligation)


def version_id(slug: Column, effective_date: Column, checksum: Column) -> Column:
    """The slug at its date, or at the first twelve digits of its checksum if undated."""
    return F.concat(slug, F.lit("@"), F.coalesce(F.date_format(effective_date, "yyyy-MM-dd"), F.substring(checksum, 1, 12)))


def content_key(path: Column, statement: Column) -> Column:
    """What stays equal for a clause from one edition to the next."""
    return F.concat_ws("|", path_text(path), normalized(statement))


def cache_key(adapter: Column, prompt_version: Column, path: Column, text: Column) -> Column:
    return F.concat_ws("|", adapter, prompt_version, F.sha2(F.concat(path_text(path), F.lit("\n"), text), 256))


def content_words(text: Column) -> Column:
    """Distinct words of three letters and more, without those every clause has."""
    found = F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def designators(text: Column) -> Column:
    """Distinct citations of issuances within running text, white space made single."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DESIGNATOR), F.lit(0)), lambda d: F.regexp_replace(d, r"(?U)\s+", " ")))


def section_heading(line: Column) -> Column:
    """The section that a line opens, or null: a named one, or a number with a final dot; never a row of a table of contents."""
    s = F.btrim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    kind, ident, number = F.regexp_extract(s, NAMED_HEADING, 1), F.regexp_extract(s, NAMED_HEADING, 2), F.regexp_extract(s, NUMBERED_HEADING, 1)
    return F.when((s == "") | s.rlike(DOT_LEADER), None).when(kind != "", F.concat_ws(" ", kind, ident)).when(number != "", number)


def lines_of(text: Column) -> Column:
    """Lines at every Unicode line boundary, without an empty one after the last boundary."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def truncated(text: Column, limit: int = 600) -> Column:
    """White space made single; beyond the limit cut, with an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))).otherwise(flat)


def uri_path(uri: Column) -> Column:
    """The path of a URI, percent decoded."""
    return F.url_decode(F.replace(F.parse_url(uri, F.lit("PATH")), F.lit("+"), F.lit("%2B")))


def token_digest(token: Column) -> Column:
    """What is kept of an access token: sha256 of its UTF-8 bytes, in hexadecimal digits."""
    return F.sha2(token, 256)


def is_digest(text: Column) -> Column:
    """Whether a text has the form of token_digest()."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
