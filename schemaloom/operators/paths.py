"""Error texts with the path of what they are about, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def located(path: Column | None, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return message if path is None else F.concat(path, F.lit(": "), message)


def below(path: Column | None, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return key if path is None else F.concat(path, F.lit("/"), key)


def first_of(errors: Column) -> Column:
    """The first of an array of texts that isn't NULL."""
    return F.get(F.filter(errors, lambda e: e.isNotNull()), 0)
