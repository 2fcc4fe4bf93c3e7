"""Text functions as columns: canonical forms, identifier boundaries, path joins, references by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results of matching depend on these.
#: Characters of identifiers; those of code in a fact; quotes around a name.
_WORD = "A-Za-z0-9_"
_CODE = "a-z0-9/:@._-"
_QUOTES = "`'\""
#: A position in a list of facts, in lower case and without blanks and quotes around it.
_POSITION = r"^(?:fact|item|no|number|#)?\s*[#.)]?\s*(\d{1,3})\s*[.)]?$"
#: Parameters of a route, and what one matches (in a replacement, so backslashes are doubled).
_PARAMETER = r":[A-Za-z_]\w*|\{[^}]+\}|<[^>]+>"
_SEGMENT = "[^/\\\\s`'\"]+"
#: Marks of a code fence.
_FENCE = "```"

_EDGE = f"[^{_WORD}]"
#: Places where a word of a mixed-case name begins: a capital behind a small letter or digit, or the last one of several.
_WORD_BEGINS = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def quoted(term: Column) -> Column:
    """term as a pattern that matches it literally."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def mentions(text: Column, term: Column, any_case: bool = True, low: Column | None = None) -> Column:
    """Whether text has term as a whole identifier. Null where either is null; an empty term is not mentioned. The pattern
    differs by row, so it is only compiled where the text holds the term at all; low: the text in lower case, if there is
    such a column. Beyond ASCII a letter may match one that lower-casing doesn't give, so there the pattern decides."""
    if any_case:
        wide = (F.octet_length(text) > F.length(text)) | (F.octet_length(term) > F.length(term))
        held = wide | F.contains(F.lower(text) if low is None else low, F.lower(term))
    else:
        held = F.contains(text, term)
    pattern = F.concat(F.lit("(?iu)" if any_case else ""), F.lit(f"(^|{_EDGE})"), quoted(term), F.lit(f"({_EDGE}|$)"))
    return F.when((F.length(term) > 0) & held, F.rlike(text, pattern)).otherwise(F.when(text.isNotNull() & term.isNotNull(), False))


def camel_words(name: Column) -> Column:
    """UserAuthService -> user auth service; underscores and hyphens part words, too. Blanks go where a word begins, found
    by what stands around the place."""
    return F.btrim(F.lower(F.regexp_replace(name, f"{_WORD_BEGINS}|[_-]+", " ")))


def canonical(text: Column) -> Column:
    """The form in which a judge's rendering of a fact is looked up: its runs of code characters in lower case, joined by
    blanks. Quotes go with what is no code character; a list number in front does not count."""
    unnumbered = F.regexp_replace(F.lower(text), f"^[{_QUOTES}\\s]*(\\d+[.)])?", "")
    return F.array_join(F.regexp_extract_all(unnumbered, F.lit(f"[{_CODE}]+"), F.lit(0)), " ")


def position_reference(text: Column) -> Column:
    """The number of one to three digits that '7', '#7', 'fact 7' or '7.' stands for; null otherwise."""
    bare = F.lower(F.btrim(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(_QUOTES + " ")))
    return F.try_to_number(F.nullif(F.regexp_extract(bare, _POSITION, 1), F.lit("")), F.lit("999")).cast("int")


def join_path(*parts: Column) -> Column:
    """Parts without slashes at their ends, empty ones dropped, joined behind a leading slash."""
    bare = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", ""))
    return F.concat(F.lit("/"), F.array_join(F.filter(bare, lambda p: p != ""), "/"))


def route_pattern(path: Column) -> Column:
    """A route as a pattern: parameters match one segment, a slash at the end is optional. The path is quoted as a whole,
    and the quotation is opened for each parameter."""
    body = F.regexp_replace(quoted(F.rtrim(path, F.lit("/"))), _PARAMETER, f"\\\\E{_SEGMENT}\\\\Q")
    return F.concat(F.lit("(?iu)"), body, F.lit(f"/?(?![{_WORD}])"))


def json_object(raw: Column) -> Column:
    """What lies between the first { and the last }; null if there is none."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def without_fence(raw: Column) -> Column:
    """The body of the first code fence, else the text itself."""
    parts = F.split(raw, _FENCE, 3)
    body = F.regexp_replace(F.try_element_at(parts, F.lit(2)), "^json", "")
    return F.when(F.size(parts) < 3, raw).otherwise(F.regexp_replace(body, r"^\s+|\s+$", ""))


def category(fact: Column) -> Column:
    return F.substring_index(fact, ":", 1)


def value(fact: Column) -> Column:
    """What follows the first colon, trimmed; empty without a colon."""
    return F.trim(F.when(F.contains(fact, F.lit(":")), F.regexp_replace(fact, r"(?s)^[^:]*:", "")).otherwise(""))
