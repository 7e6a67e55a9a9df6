from __future__ import annotations

import pytest
from llm_samples import CLASHING, DOCUMENTS, texts


@pytest.fixture(scope="session")
def tricky(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a long text, and clashing columns."""
    rows = [(*r, *["?"] * len(CLASHING)) for r in texts()]
    schema = DOCUMENTS + "".join(f", {n} string" for n in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) of the tricky documents, a null text as empty."""
    return [(r[0], r[1] or "") for r in texts()]
