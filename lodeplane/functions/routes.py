"""HTTP routes (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters in the notations of common frameworks.
PARAM = r"\$\{[^}/]*\}|\{[^}/]*\}|<[^>/]*>|:[A-Za-z_][A-Za-z0-9_]*"


def canonical(route: Column | str, mark: str = ":_") -> Column:
    """One spelling per route: parameters become ``mark``, slashes are squeezed, the last one dropped; empty is ``/``."""
    r = F.regexp_replace(route, PARAM, mark)
    r = F.regexp_replace(r, r"/+", "/")
    return F.when(F.length(r) > 1, F.regexp_replace(r, r"/$", "")).when(r == "", F.lit("/")).otherwise(r)


def path_of_url(url: Column | str) -> Column:
    """The path of an absolute URL, or of a relative one, without query and fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def shape(route: Column | str) -> Column:
    """Segments reduced to ``:p`` for parameters and ``W`` for words."""
    seg = lambda s: F.when(s.startswith(":"), ":p").when(s.rlike(r"^[A-Za-z0-9_-]+$"), "W").otherwise(s)
    return F.array_join(F.transform(F.split(route, "/"), seg), "/")


def template_regex(route: Column | str) -> Column:
    """A regular expression that literal paths of a route template match."""
    bare = F.regexp_replace(route, r"/+$", "")
    escaped = F.regexp_replace(bare, r"([.+*?^$|()\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r":[A-Za-z_]\w*|\{[A-Za-z_]\w*\}|<[A-Za-z_]\w*>", "[^/]+"), F.lit("$"))
