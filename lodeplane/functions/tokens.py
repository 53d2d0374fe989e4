"""Search tokens of identifiers and prose (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search (fixed values).
STOP_WORDS = "the and or but is in on at to of a an for with by as be this that it from into return const let var function async await".split()
LEAST = 2


def tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens: whole words, and their parts at case, digit and punctuation borders."""
    words = F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[^A-Za-z0-9_]+"), lambda w: w != "")

    def parts(w: Column) -> Column:
        camel = F.regexp_replace(F.regexp_replace(w, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2")
        return F.split(F.lower(camel), r"[_\-./\s]+")

    all_ = F.concat(F.transform(words, F.lower), F.flatten(F.transform(words, parts)))
    return F.array_distinct(F.filter(all_, lambda t: (F.length(t) >= LEAST) & ~t.isin(*STOP_WORDS)))
