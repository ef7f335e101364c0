"""Selected physical lines of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import lines

LINE_BYTES = 1 << 20


def read_lines(docs: DataFrame, text: Column, wanted: DataFrame, key: str = "doc_id", line_bytes: int = LINE_BYTES) -> DataFrame:
    """Rows (key, line, value, text) for the rows (key, line, value) of ``wanted``.

    Texts without a wanted line leave before they are cut into lines; lines
    come back as bytes, ``line_bytes`` of them at most.
    """
    asked = docs.join(wanted.select(key).distinct(), key, "left_semi")
    found = lines(asked, text, key).join(wanted, [key, "line"])
    return found.select(key, "line", "value", F.substring(F.encode("text", "UTF-8"), 1, line_bytes).alias("text"))
