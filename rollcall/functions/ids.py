"""Ids: random ones, and ones that follow from a key."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError


def keyed_id(key: Column) -> Column:
    """A version-4-shaped id that follows from a key, whatever the partitioning."""
    k = F.md5(key.cast("string"))
    return F.concat(
        F.substring(k, 1, 8), F.lit("-"), F.substring(k, 9, 4), F.lit("-4"), F.substring(k, 14, 3), F.lit("-8"), F.substring(k, 18, 3), F.lit("-"), F.substring(k, 21, 12)
    )


def random_id() -> str:
    return str(uuid.uuid4())


def random_ids(count: int) -> list[str]:
    """Many at once, from the system's entropy."""
    raw = np.frombuffer(os.urandom(16 * count), dtype=np.uint8).reshape(count, 16).copy()
    raw[:, 6] = raw[:, 6] & 0x0F | 0x40
    raw[:, 8] = raw[:, 8] & 0x3F | 0x80
    digits = raw.tobytes().hex()
    return ["-".join((digits[a : a + 8], digits[a + 8 : a + 12], digits[a + 12 : a + 16], digits[a + 16 : a + 20], digits[a + 20 : a + 32])) for a in range(0, 32 * count, 32)]


def parsed_id(text: str) -> str:
    """The canonical form of an id that a client sent: 32 hexadecimal digits, with or without hyphens, in braces, or as a URN."""
    if isinstance(text, str):
        digits = text.replace("urn:", "").replace("uuid:", "").strip("{}").replace("-", "")
        if re.fullmatch("[0-9a-fA-F]{32}", digits):
            return str(uuid.UUID(digits))
    raise RequestError(f"not an id: {text!r}")
