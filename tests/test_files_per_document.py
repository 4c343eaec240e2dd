"""SRC1 and SRC2 over a file for each document: as many rows as documents, with their sizes and texts."""

from corpusq import queries_files


def test_each_document_is_a_file(spark, tmp_path):
    rows = [(i, f"text {i} ä\nline") for i in range(150)] + [(-3, None), (200, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole = {i: (t or "") + "\n" for i, t in rows}
    listed = {r.doc_id: (r.extension, r.size) for r in queries_files.src1_corpus(spark, str(tmp_path)).collect()}
    assert listed == {i: (".txt", len(t.encode())) for i, t in whole.items()}
    texts = [(r.doc_id, r.text) for r in queries_files.src2_plain_texts(spark, str(tmp_path)).collect()]
    assert sorted(texts) == sorted(whole.items())
