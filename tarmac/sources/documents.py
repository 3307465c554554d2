"""JSON documents stored as shredded VARIANT columns, parsed once when they are stored.

Spark writes the common fields of a VARIANT as Parquet columns of their own (shredding), and a read of some paths reaches the scan as those
columns. Readers of a stored document therefore neither parse text nor read the rest of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.sources.scratch import stage

TEXT, DOCUMENT, BLANK = "payload", "document", "blank"


def is_stored(responses: DataFrame) -> bool:
    return DOCUMENT in responses.columns


def parsed(responses: DataFrame, text: str = TEXT) -> DataFrame:
    """The rows with ``document`` in place of the text, and ``blank`` where there was none or an empty object.

    Text that is no JSON, or repeats a key in an object, becomes a NULL document that is not blank.
    """
    blank = F.col(text).isNull() | (F.trim(text) == "{}")
    return responses.withColumns({DOCUMENT: F.try_parse_json(text), BLANK: blank}).drop(text)


def stored_documents(responses: DataFrame, text: str = TEXT, label: str = "documents") -> DataFrame:
    """``parsed`` rows as a written table. Rows that hold a document already are returned as they are."""
    return responses if is_stored(responses) else stage(parsed(responses, text), label)


def document(responses: DataFrame) -> Column:
    """The stored document, or the text parsed here and now."""
    return F.col(DOCUMENT) if is_stored(responses) else F.try_parse_json(TEXT)
