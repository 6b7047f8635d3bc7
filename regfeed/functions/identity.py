"""Company number of an event, by feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a feed's resource URI holds the company number.
URI_PATTERNS = {
    "filings": "^/company/([A-Z0-9]{8})/filing-history",
    "officers": "^/company/([A-Z0-9]{8})/appointments",
    "persons-with-significant-control": "^/company/([A-Z0-9]{6,8})/persons-with-significant-control",
    "charges": "^/company/([A-Z0-9]{8})/charges",
    "persons-with-significant-control-statements": "^/company/([A-Z0-9]{8})/",
    "company-exemptions": "company/([A-Z0-9]{8})/exemptions",
}


def company_number(stream_path: Column, resource_uri: Column, resource_id: Column, data_number: Column) -> Column:
    """NULL when the URI does not match; empty for feeds that carry no company number."""
    number = F.when(stream_path == "companies", data_number).when(stream_path == "insolvency-cases", resource_id)
    for feed, pattern in URI_PATTERNS.items():
        # The first match, or NULL: the URI is named once, which keeps generated code small.
        number = number.when(stream_path == feed, F.try_element_at(F.regexp_extract_all(resource_uri, F.lit(pattern), F.lit(1)), F.lit(1)))
    return number.otherwise(F.lit(""))
