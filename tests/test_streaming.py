from pdf_files import plain

from leafmill.streaming.watch import watch


def test_new_files_are_taken_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for batch, name in enumerate(("a", "b")):
        (folder / f"{name}.pdf").write_bytes(plain())
        (folder / "other.txt").write_text("x")
        watch(spark, str(folder), str(out), str(tmp_path / "checkpoint")).awaitTermination()
        status = spark.read.parquet(f"{out}/status")
        assert status.count() == batch + 1
    found = spark.read.parquet(f"{out}/assertions")
    assert found.where("profile = 'ua1' AND rule_id = '7.2-34'").select("doc_id").distinct().count() == 2
