from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(text, text, ...) with ids from 0, or documents((id, text), ...)."""

    def build(*rows):
        pairs = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCUMENTS)

    return build


@pytest.fixture
def clashing(documents):
    """Documents whose further columns have the names of results."""
    from pyspark.sql import functions as F

    names = ["kept", "node", "bucket", "component", "a", "b", "_other_id", "n_lines", "n_removed", "removed", "_gone",
             "component_id", "lang_pred", "score", "item_id", "ids", "n_tokens", "stratum"]
    frame = documents(None, "", " ", "one two three four five six seven", "one two three four five six seven", "x" * 70)
    return frame.withColumns({name: F.lit("other") for name in names})
