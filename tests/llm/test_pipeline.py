"""The stages over a small corpus, each against what it is to do."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    prose = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    rows = [(i, "\n".join(prose("abcdefgh" if i % 2 else "stuvwxyz", 40) for _ in range(3)), "one" if i % 2 else "two", "s", 1) for i in range(40)]
    item = prose("abcdefgh", 30)
    rows += [(100, "12 34 !!", "one", "s", 8), (101, rows[3][1], "one", "s", 1), (102, prose("abcdefgh", 50) + " " + item, "one", "s", 1)]
    near = rows[5][1].replace("\n", " ").split()
    rows += [(103, " ".join(near), "one", "s", 1), (104, " ".join([*near[:60], "changed", *near[61:]]), "one", "s", 1), (105, None, "one", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    language, lines, near_, clean = left
    assert set(language) == {r[0] for r in rows} - {100, 105}
    assert set(lines) == set(language)
    assert lines[101] == ""
    assert lines[3] == rows[3][1]
    assert set(lines) - set(near_) == {103, 104}  # the same words as document 5, and nearly the same
    assert set(near_) - set(clean) == {102}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, null ids, equal rows and clashing names."""
    import corpus_pipeline

    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, same), (1, same), (1, same + " tail"), (None, same), (3, same), (None, "alone"), (None, "alone"), (4, None), (5, ""), (7, "other words")]
    docs = spark.createDataFrame([(i, t, k, "u", 5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, uid long, `first` string, `id` int")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert len(kept) == 4
    assert kept[0][:2] == (False, 1) and kept[0][2] in (same, same + " tail")
    assert kept[1:] == [(False, 4, ""), (False, 7, "other words"), (True, 0, "alone")]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
