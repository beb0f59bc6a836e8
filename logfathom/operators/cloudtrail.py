"""CloudTrail documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions import severity as sev
from logfathom.functions.text import filled, strip
from logfathom.model import emit, stage, text_map
from logfathom.sources.documents import element_list, explode_records, trail_list


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def user_of(record: Column) -> Column:
    """First non-empty of user name, session issuer, end of the principal, type."""
    who = "$.userIdentity"
    return F.coalesce(
        filled(_text(record, f"{who}.userName")),
        filled(_text(record, f"{who}.sessionContext.sessionIssuer.userName")),
        filled(F.substring_index(_text(record, f"{who}.principalId"), ":", -1)),
        filled(_text(record, f"{who}.type")),
    )


# member -> default text
_MEMBERS = {
    "eventName": "", "eventTime": "", "sourceIPAddress": "", "awsRegion": "", "eventSource": "",
    "errorCode": "", "errorMessage": "", "eventType": "AwsApiCall", "requestID": "",
}


def normalize_cloudtrail(
    df: DataFrame, doc_col: str = "value", *, elements: bool = False, key: list[str] | None = None, keep: list[str] = ()
) -> DataFrame:
    """One document per row to one event per record; with ``elements`` a row is a
    record that was cut out of its document.

    Text that is no JSON gives no event. Missing texts are empty, not NULL.
    """
    trimmed = df.withColumn(doc_col, strip(F.col(doc_col)))
    flat = explode_records(trimmed, doc_col, element_list if elements else trail_list).filter(F.col("record").isNotNull())
    record = F.col("record")
    staged = stage(
        flat,
        [
            {
                f"__ct_{name}": F.coalesce(
                    F.try_variant_get(record, f"$.{name}", "string"), F.lit(default)
                )
                for name, default in _MEMBERS.items()
            }
            | {"__ct_user": user_of(record)}
        ],
    )
    part = {name: F.col(f"__ct_{name}") for name in _MEMBERS}
    name, ip, error = part["eventName"], part["sourceIPAddress"], part["errorCode"]
    service, user = part["eventSource"], F.col("__ct_user")
    unknown = F.lit("unknown")
    level = sev.of_api_call(name, error)
    done = F.concat(
        F.lit("AWS "), name, F.lit(" by "), F.coalesce(user, unknown),
        F.lit(" from "), F.coalesce(filled(ip), unknown),
    )
    failed = F.concat(
        F.lit("AWS "), name, F.lit(" FAILED ("), error, F.lit("): "),
        F.coalesce(filled(part["errorMessage"]), F.lit("no details")),
    )
    fields = {
        "timestamp": part["eventTime"],
        "source_format": F.lit("aws_cloudtrail"),
        "source_ip": F.when(~ip.endswith(".amazonaws.com"), ip),
        "event_type": F.concat(
            F.lit("AWS/"),
            F.when(service == "", F.lit("CloudTrail")).otherwise(
                F.upper(F.substring_index(service, ".", 1))
            ),
        ),
        "event_action": name,
        "severity": level.label,
        "severity_code": level.code,
        "username": user,
        "message": F.when(error != "", failed).otherwise(done),
        "raw": F.col("text"),
        "extensions": text_map(
            ("aws_region", part["awsRegion"]),
            ("event_source", service),
            ("event_type", part["eventType"]),
            ("error_code", error),
            ("error_message", part["errorMessage"]),
            ("request_id", part["requestID"]),
            ("user_type", F.try_variant_get(record, "$.userIdentity.type", "string")),
            ("account_id", F.try_variant_get(record, "$.userIdentity.accountId", "string")),
            ("request_params", F.try_variant_get(record, "$.requestParameters", "string")),
        ),
    }
    if key is not None:
        key = [*key, "sub"]
    return emit(staged, fields, key, keep)
