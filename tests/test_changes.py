import hashlib
from collections import defaultdict

import pytest

from codeatlas.operators import changes


@pytest.mark.parametrize("piece", [1 << 20, 150])
def test_directory_hash_in_pieces(spark, monkeypatch, piece):
    """The same hash as over all pairs joined, with no list of a directory's pairs in any one row."""
    monkeypatch.setattr(changes, "PIECE", piece)
    rows = [(k, f"text {k % 7}" if k % 11 else None, [None, "a", "b", "a"][k % 4]) for k in range(400)] + [(5, "again", "a"), (5, "text 5", "a"), (900, None, "only nulls")]
    df = spark.createDataFrame(rows, "k long, text string, source string").repartition(5)
    want = defaultdict(list)
    for k, text, source in rows:
        want[source] += [(k, hashlib.sha256(text.encode()).hexdigest())] if text is not None else []
    want = {s: hashlib.sha256("".join(f"{k}:{h}" for k, h in sorted(p)).encode()).hexdigest() for s, p in want.items()}
    found = changes.directory_hash(df, "source", "k", "text")
    assert found.columns == ["source", "hash"] and "collect_list" not in found._jdf.queryExecution().toString()
    found = found.collect()
    assert len(found) == len(want) and {r["source"]: r["hash"] for r in found} == want
