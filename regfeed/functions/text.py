"""Letter case and template filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A placeholder, a run of other text, or a lone brace.
_TOKENS = r"\{[0-9A-Za-z_]+\}|[^{]+|\{"
_PLACEHOLDER = r"^\{[0-9A-Za-z_]+\}$"


def sentence_case(text: Column) -> Column:
    """Lower case, anything but letters and digits to single spaces, first letter capital."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def title_case(text: Column) -> Column:
    """First letter of every space-separated word capital, the rest lower."""
    return F.initcap(F.lower(text))


def fill_template(template: Column, values: Column) -> Column:
    """Replace ``{name}`` by the map's value, or by nothing.

    The template is cut into tokens first, so braces inside a value are never filled again.
    """

    def fill(token: Column) -> Column:
        name = F.substring(token, 2, F.length(token) - 2)
        return F.when(token.rlike(_PLACEHOLDER), F.coalesce(values[name], F.lit(""))).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(_TOKENS), F.lit(0)), fill), "")
