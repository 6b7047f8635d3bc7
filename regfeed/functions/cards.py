"""Title and description of an event, as shown to readers.

``data`` is the payload as VARIANT; it is read by path, never parsed again. Each output is one ``when`` chain, so the
whole card is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfeed.functions.identity import company_number
from regfeed.functions.text import fill_template, sentence_case, title_case
from regfeed.session import broadcast_if_small

# Texts for feeds that have no description of their own.
STATEMENT_TEXT = "PSC statement descriptions not yet developed"
EXEMPTION_TEXT = "Company exemptions descriptions not yet developed"
NO_DESCRIPTION = "No description available"
# Words around dates and names.
RESIGNED, APPOINTED, CEASED, NOTIFIED = "Resigned on ", "Appointed on ", "Ceased on ", "Notified on "
DISQUALIFIED, INSOLVENCY, FILING, NEW = "Disqualified from ", "Insolvency", " filing", "New"


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("data"), path, "string")


def _present(path: str) -> Column:
    """Whether the key is there; a JSON null counts as there."""
    return F.try_variant_get(F.col("data"), path, "variant").isNotNull()


def _texts(path: str, inner: str) -> Column:
    """``inner`` of every item of the array at ``path``."""
    items = F.try_variant_get(F.col("data"), path, "array<variant>")
    return F.transform(items, lambda item: F.try_variant_get(item, inner, "string"))


def _disqualified_from() -> Column:
    items = F.try_variant_get(F.col("data"), "$.disqualifications", "array<variant>")
    names = F.flatten(F.transform(items, lambda d: F.try_variant_get(d, "$.company_names", "array<string>")))
    return F.concat(F.lit(DISQUALIFIED), F.coalesce(F.array_join(names, ", "), F.lit("")))


def _dated(key: str, ended: str, other_key: str, started: str) -> Column:
    """A key that is there counts, even with JSON null, which readers see as ``null``; one that is not is ``undefined``."""
    value = lambda k: F.coalesce(_text(f"$.{k}"), F.when(_present(f"$.{k}"), "null"), F.lit("undefined"))
    return F.when(_present(f"$.{key}"), F.concat(F.lit(ended), value(key))).otherwise(F.concat(F.lit(started), value(other_key)))


def title(feed: Column) -> Column:
    feed_name = title_case(F.regexp_replace(feed, "-", " "))
    three_names = [F.coalesce(_text(f"$.{key}"), F.lit("")) for key in ("forename", "other_forenames", "surname")]
    chosen = (
        F.when(feed == "companies", title_case(_text("$.company_name")))
        .when(feed == "filings", F.concat(sentence_case(F.coalesce(_text("$.category"), F.lit(NEW))), F.lit(FILING)))
        .when(feed == "officers", title_case(_text("$.name")))
        .when(feed == "persons-with-significant-control", _text("$.name"))
        .when(feed == "charges", _text("$.classification.description"))
        .when(feed == "insolvency-cases", F.lit(INSOLVENCY))
        .when(feed == "disqualified-officers", F.concat_ws(" ", *three_names))
        .when(feed.isin("persons-with-significant-control-statements", "company-exemptions"), title_case(_text("$.linked_psc_name")))
    )
    return F.coalesce(chosen, feed_name)


def description(feed: Column, filing_text: Column) -> Column:
    cases = F.array_join(F.transform(_texts("$.cases", "$.type"), sentence_case), ", ")
    return (
        F.when(feed == "companies", F.lit(""))
        .when(feed == "filings", filing_text)
        .when(feed == "officers", _dated("resigned_on", RESIGNED, "appointed_on", APPOINTED))
        .when(feed == "persons-with-significant-control", _dated("ceased_on", CEASED, "notified_on", NOTIFIED))
        .when(feed == "charges", _text("$.particulars.description"))
        .when(feed == "insolvency-cases", cases)
        .when(feed == "disqualified-officers", _disqualified_from())
        .when(feed == "persons-with-significant-control-statements", F.lit(STATEMENT_TEXT))
        .when(feed == "company-exemptions", F.lit(EXEMPTION_TEXT))
        .otherwise(F.lit(NO_DESCRIPTION))
    )


def filing_text(code: Column, template_filled: Column, free_text: Column) -> Column:
    """Dictionary text, else the free text of a legacy filing, else the code itself."""
    return F.coalesce(template_filled, F.when(code == "legacy", free_text), code)


def described(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``filing_text`` from the description dictionary (code, template) for filings.

    Only filings are joined. Rows of other feeds carry a NULL code, which a shuffled join would gather in one task.
    """
    code = F.when(F.col("stream_path") == "filings", _text("$.description"))
    values = F.try_variant_get(F.col("data"), "$.description_values", "map<string,string>")
    entries = broadcast_if_small(dictionary)
    coded = events.withColumn("code", code)
    joined = coded.where("code is not null").join(entries, "code", "left")
    filled = F.when(F.col("template").isNotNull(), fill_template(F.col("template"), F.coalesce(values, F.create_map().cast("map<string,string>"))))
    free = _text("$.description_values.description")
    texts = joined.withColumn("filing_text", filing_text(F.col("code"), filled, free)).drop("template")
    return texts.unionByName(coded.where("code is null").withColumn("filing_text", F.lit(None).cast("string")))


def cards(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One card per event: company number, title, description."""
    feed = F.col("stream_path")
    number = company_number(feed, F.col("resource_uri"), F.col("resource_id"), _text("$.company_number"))
    return (
        described(events, dictionary)
        .withColumn("company_number", number)
        .withColumn("title", title(feed))
        .withColumn("description", description(feed, F.col("filing_text")))
    )
