"""Name-based identifiers as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of issue ids, which other producers share.
ISSUE_NAMESPACE = "584b5a7e983f47f08de1f9483dd695b7"
# Own namespaces: version-5 ids of names under this package.
OTEL_NAMESPACE = "e054df4ada0454868de0fd87f3bccf59"
BATCH_NAMESPACE = "0887df38f3fb584c8e83868f5c483472"


def uuid5(namespace: str, text: Column) -> Column:
    """RFC 4122 version-5 UUID of ``text`` in ``namespace``, without dashes."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )


def issue_id(title: Column, fingerprint: Column) -> Column:
    """Issue id: uuid5 of the fingerprint, or of the title where there is none."""
    return uuid5(ISSUE_NAMESPACE, F.coalesce(fingerprint, title, F.lit("Error")))
