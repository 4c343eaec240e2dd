"""Files for rows: tasks write them themselves, many in one folder, a file for each row even if ids come again."""

import os

from corpusq import queries_files
from corpusq.sources import files, streams


def test_rows_become_files_in_few_folders(spark, monkeypatch):
    monkeypatch.setattr(files, "IN_FOLDER", 50)
    rows = [(i, f"text {i} ä\r\n") for i in range(400)] + [(7, "again"), (7, "again"), (-1, "-")]
    path = streams.shared_path(spark, "each")
    files.write_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id", path)
    found = [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://")) for f in names]
    assert len(found) == 403 and len({os.path.dirname(f) for f in found}) <= 10
    assert sorted(f.endswith(".txt") and open(f, "rb").read().decode() for f in found) == sorted(t for _, t in rows)
    assert files.corpus(spark, path).count() == 403


def test_ids_that_come_again_are_files_of_their_own(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.text) for r in queries_files.src2_plain_texts(spark, str(tmp_path)).collect())
    assert got == [(1, "a\n"), (1, "a\n"), (1, "b\n"), (2, "\n")]
    assert sorted((r.doc_id, r.size) for r in queries_files.src1_corpus(spark, str(tmp_path)).collect()) == [(1, 2), (1, 2), (1, 2), (2, 1)]
