"""Keys by which names collide: what no built-in column function gives, for each different name of a batch once."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collision_text(name: str) -> str:
    """Composed, and full letter case folded: ß and ss, and an accent written in either way, agree."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())


def _keyed(names: pa.Array, key) -> pa.Array:
    known = names.dictionary_encode()
    return pa.array([None if x is None else key(x) for x in known.dictionary.to_pylist()], pa.string()).take(known.indices)


@F.arrow_udf(StringType())
def collision_key(names: pa.Array) -> pa.Array:
    """null for null; gaps at the ends count."""
    return _keyed(names, collision_text)


@F.arrow_udf(StringType())
def font_key(names: pa.Array) -> pa.Array:
    """F17 of font names: without gaps at the ends, letter case folded; null for null."""
    return _keyed(names, lambda x: x.strip().casefold())
