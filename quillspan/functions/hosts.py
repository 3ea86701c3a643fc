"""Host and address expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_host(host: Column) -> Column:
    """Lower case, without one leading ``www.``; null stays null."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")
