"""Vectors are summed where their texts are; the index is written from rows that are sent once."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from relevo.operators import vectors as V


def _vectors(rows, dim):
    """Vectors by id of ``(id, tokens)`` rows, as the docstring of ``hashed_vectors`` has them."""
    df = Counter(t for _, tokens in rows for t in set(tokens))
    idf = {t: math.floor(math.log((len(rows) + 1.0) / (n + 1)) * V.IDF_SCALE) for t, n in df.items()}
    made = defaultdict(lambda: [0] * dim)
    for i, tokens in rows:
        for t in tokens:
            h = hashlib.md5(t.encode()).hexdigest()
            made[i][int(h[:7], 16) % dim] += idf[t] * (1 if int(h[7], 16) % 2 == 0 else -1)
    norm = {i: math.sqrt(sum(float(e) * e for e in x)) for i, x in made.items()}
    return {i: [e / norm[i] if norm[i] else 0.0 for e in x] for i, x in made.items()}


@pytest.mark.parametrize("frequent", [1, 5, 1000])
def test_vectors_do_not_depend_on_which_terms_are_frequent(spark, monkeypatch, frequent):
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(1, 3 + i % 9)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "w1 w1 w50 Ünï"), (7, "w1 w1 w50 Ünï"), (None, "w2 w51"), (None, "w2"),
                                                    (61, None), (62, ""), (63, " .,"), (64, "w99")]
    monkeypatch.setattr(V, "FREQUENT", frequent, raising=False)
    df = spark.createDataFrame(rows, "id long, body string")
    want = _vectors([(i, (t or "").lower().replace(".,", "").split()) for i, t in rows], 16)
    got = V.embed(df, "body", 16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["vector"] == pytest.approx(want.get(r["id"], [0.0] * 16), abs=1e-8)
    made = V.hashed_vectors(df, V.idf_table(df), "body", 16)
    assert {r["doc_id"] for r in made.collect()} == {i for i, t in rows if t and t.strip(" .,")}


def test_tokens_of_frequent_terms_are_no_rows(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} all") for i in range(50)], "id long, body string")
    made = V.hashed_vectors(df, V.idf_table(df), "body", 16)
    assert made.count() == 50
    assert "Generate" not in made._jdf.queryExecution().toString()  # no row a token, none is shuffled


def test_index_counts_its_written_postings_and_is_packed_tightly(spark, tmp_path):
    from glob import glob

    import pyarrow.parquet as pq

    from relevo.operators import lexical as L

    rows = [(1, "a b a"), (2, "b c"), (2, "b c"), (3, None), (None, "c d")]
    path = L.write_index(spark.createDataFrame(rows, "id long, body string"), str(tmp_path / "index"))
    index = L.open_index(spark, path)
    assert {tuple(r) for r in index.dfreq.collect()} == {("a", 1), ("b", 3), ("c", 3), ("d", 1)}
    assert index.postings.count() == 8 and index.stats.first()["n_docs"] == 4
    files = glob(f"{path}/postings/v=0/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
