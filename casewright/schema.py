"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()


def _of(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


COMPLAINTS = _of(
    ("complaint_id", _L), ("date_received", _D), ("month", _S), ("product", _S), ("segment", _S), ("sub_product", _S), ("issue", _S), ("sub_issue", _S), ("company", _S),
    ("state", _S), ("zip_code", _S), ("tags", _S), ("submitted_via", _S), ("company_response", _S), ("company_public_response", _S), ("timely", _S),
    ("date_sent_to_company", _S), ("has_narrative", _I), ("narrative", _S),
)

#: Headers of the public extract, with the column each becomes.
EXTRACT_HEADERS = {
    "Date received": "date_received",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "narrative",
    "Company public response": "company_public_response",
    "Company": "company",
    "State": "state",
    "ZIP code": "zip_code",
    "Tags": "tags",
    "Submitted via": "submitted_via",
    "Date sent to company": "date_sent_to_company",
    "Company response to consumer": "company_response",
    "Timely response?": "timely",
    "Complaint ID": "complaint_id",
}

POPULATION = _of(("state", _S), ("year", _I), ("population", _L))
LEDGER = _of(("filter_key", _S), ("window_start", _D), ("window_end", _D), ("expected", _L), ("received", _L), ("inserted", _L), ("fetched_at", T.TimestampType()))
META = _of(("key", _S), ("value", _S))

INDEX = {
    "text_month": _of(("hash", _S), ("month", _S), ("n", _L)),
    "text_state_month": _of(("hash", _S), ("state", _S), ("month", _S), ("n", _L)),
    "text_company_month": _of(("hash", _S), ("company", _S), ("month", _S), ("n", _L)),
    "monthly": _of(("segment", _S), ("month", _S), ("complaints", _L), ("narratives", _L)),
    "company_month": _of(("company", _S), ("segment", _S), ("month", _S), ("complaints", _L), ("narratives", _L)),
    "state_month": _of(("state", _S), ("month", _S), ("complaints", _L), ("narratives", _L)),
    "relief_month": _of(("segment", _S), ("month", _S), ("hash", _S), ("relieved", _I), ("n", _L)),
}
