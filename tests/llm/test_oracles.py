"""The registered text queries: against SQL where there is some, else their contract's columns, on the smallest tables."""

import pytest

from placeloom.llm import queries

from ..comparing import assert_same, connected
from ..conftest import SF

COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "held_out", "score", "predicted"], 3: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    4: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], 5: ["doc_id", "item_id"], 6: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    7: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 8: ["page_id", "host", "path", "rule", "verdict"], 9: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], 10: ["doc_id", "n_shingles", "component_id", "kept"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connected(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_contract(spark, n):
    (name,) = [q for q in queries.queries() if q.startswith(f"op{n}_")]
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[n])] == COLUMNS[n]
    rows = df.count()
    whole = {8: "pages"}.get(n, "documents")
    assert rows > 0 and (n in (4, 5) or rows == spark.read.parquet(f"{SF}/{whole}.parquet").count())
