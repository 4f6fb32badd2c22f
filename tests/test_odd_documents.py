"""Queries against their SQL over documents that the generated tables don't have: empty and null texts, ids that come twice or are null."""

import pytest

from quarry import catalogue
from tests.oracle import compare

# 127 bytes of one value and a tie at the sixth place: entropies that are short binary fractions
_TIE = "".join(c * n for c, n in zip("abcdefgh", (64, 32, 16, 8, 4, 2, 1, 1)))
_ONCE = [(0, ""), (1, "a"), (2, None), (10, "ä" * 700), (20, ""), (30, "xyz" * 1000), (40, "x" * 1024), (50, _TIE), (60, "é" + "0123456789" * 900)]
_TWICE = [*_ONCE, (30, "xyz" * 1000), (30, "other " * 500), (0, "late"), (20, ""), (2, None), (None, "no id"), (None, "nor this")]


@pytest.fixture(scope="module", params=["once", "twice"])
def odd(request, spark, tmp_path_factory):
    """A folder of tables with odd documents; ids occur once, or some of them more often."""
    at = tmp_path_factory.mktemp("odd")
    rows = _ONCE if request.param == "once" else _TWICE
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").toPandas().to_parquet(at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["entropy_per_document", "range_chunk_prune", "read_capsule_roundtrip", "read_range", "compress_verify"])
def test_odd_documents_equal_sql(spark, odd, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], odd)
