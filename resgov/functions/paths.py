"""File paths as Spark's sources give them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain_path(path: Column, escaped: bool = False) -> Column:
    """A local path or URI with one form of ``file:``.

    ``_metadata.file_path`` escapes characters (pass ``escaped``), the binary-file source's ``path`` does not.
    """
    text = F.url_decode(F.regexp_replace(path, r"\+", "%2B")) if escaped else path
    return F.regexp_replace(text, "^file:/+", "/")
