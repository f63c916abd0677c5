"""Node identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.NAMESPACE_URL


def node_id(node_type: Column, path: Column, name: Column) -> Column:
    """The version-5 UUID of ``type:path:name`` in the URL namespace, in the JVM."""
    key = F.concat(node_type, F.lit(":"), path, F.lit(":"), name).cast("binary")
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), key))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.lower(F.hex(nibble)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
