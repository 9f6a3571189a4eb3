"""Questions with phrases and operators, as the atoms that they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as text_functions
from tessera.functions.bind import let

#: A word, a phrase in quotes, either with a sign before it, or one of the operators.
_PART = r'((?:(?<=^|\s)[+-])?(?:"[^"]*"|[\p{L}\p{N}]+))'


def atoms(query: Column) -> Column:
    """Array of (terms, sign): sign + must be met, - must not be, an empty one may be.

    Words and phrases (in quotes) are in the tokens of texts. ``OR`` parts what may be met and is the default;
    ``AND`` makes both its sides a must, ``NOT`` what follows it a must not, like the signs.
    An atom that comes twice counts once, under its strictest sign; null gives an empty array.
    """
    parts = F.coalesce(F.regexp_extract_all(query, F.lit(_PART), F.lit(1)), F.array().cast("array<string>"))

    def told(ps: Column) -> Column:
        near = lambda i, d: F.coalesce(F.get(ps, i + d), F.lit(""))
        sign = lambda part, i: F.when((near(i, -1) == "NOT") | part.startswith("-"), "-").when((near(i, -1) == "AND") | (near(i, 1) == "AND") | part.startswith("+"), "+").otherwise("")
        terms = lambda part: F.when(part.isin("AND", "OR", "NOT"), F.array().cast("array<string>")).otherwise(text_functions.tokens(part))
        return F.filter(F.transform(ps, lambda part, i: F.struct(terms(part).alias("terms"), sign(part, i).alias("sign"))), lambda a: F.size(a["terms"]) > 0)

    def once(every: Column) -> Column:
        has = lambda terms, sign: F.exists(every, lambda a: (a["terms"] == terms) & (a["sign"] == sign))
        strict = lambda terms: F.when(has(terms, F.lit("-")), "-").when(has(terms, F.lit("+")), "+").otherwise("")
        return F.transform(F.array_distinct(F.transform(every, lambda a: a["terms"])), lambda t: F.struct(t.alias("terms"), strict(t).alias("sign")))

    return let(let(parts, told), once)
