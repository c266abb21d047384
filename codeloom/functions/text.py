"""Text functions: identifier tokens, URL and route normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_tokens(text: Column) -> Column:
    """Lower-cased distinct pieces of an identifier or path: split at case changes and at `. _ - / :` and blanks."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(apart), r"[\s._\-/:]+"), lambda x: x != ""))


#: An HTTP scheme with its host; and a host with a path but no scheme.
SCHEME, BARE = r"(?is)^https?://([^/?#]+)(.*)$", r"(?s)^([a-zA-Z0-9._-]+)(/[a-zA-Z0-9_./%-].*)$"


def _target(url: Column) -> tuple[Column, Column]:
    """(host, rest) of a trimmed target: of an HTTP address, of a bare `host/path`, or none and the target."""
    text = F.trim(url)
    web, bare = text.rlike(SCHEME), text.rlike(BARE)
    host = F.when(web, F.regexp_extract(text, SCHEME, 1)).when(bare, F.regexp_extract(text, BARE, 1))
    rest = F.when(web, F.regexp_extract(text, SCHEME, 2)).when(bare, F.regexp_extract(text, BARE, 2)).otherwise(text)
    return host, F.when(web & (rest == ""), "/").otherwise(rest)


def target_path(url: Column) -> Column:
    """The path of an HTTP target: scheme, host, query and fragment off, one trailing slash off (not of `/`); null for
    what does not begin with a slash then."""
    path = F.regexp_replace(_target(url)[1], r"(?s)[?#].*$", "")
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, r"/\z", "")).otherwise(path)
    return F.when(path.startswith("/"), path)


def target_host(url: Column) -> Column:
    """The host of an HTTP target as written; null where there is none."""
    return _target(url)[0]


def route_path(path: Column) -> Column:
    """A route's path, trimmed, without one trailing slash (but `/` stays)."""
    text = F.trim(path)
    return F.when((F.length(text) > 1) & text.endswith("/"), F.regexp_replace(text, r"/\z", "")).otherwise(text)


def is_parameter(segment: Column) -> Column:
    """Whether a route segment stands for any value: `:x`, `{x}` or `<x>`."""
    return segment.startswith(":") | segment.rlike(r"^\{.*\}$") | segment.rlike("^<.*>$")
