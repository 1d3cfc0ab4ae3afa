from codeloom.sources import files
from codeloom.streaming import index


def test_index_follows_files(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.txt").write_text("one\n\ntwo")
    index.follow(files.new_files(spark, str(source)), target, mark, once=True).awaitTermination()
    assert [r.content for r in index.live(spark, target).collect()] == ["one\n\ntwo"]
    (source / "b.txt").write_text("x" * 2000 + "\n\n" + "y")
    index.follow(files.new_files(spark, str(source)), target, mark, once=True).awaitTermination()
    rows = sorted((r.path.rsplit("/", 1)[1], r.chunk, r.n_bytes) for r in index.live(spark, target).collect())
    assert rows == [("a.txt", 0, 8), ("b.txt", 0, 2002), ("b.txt", 1, 1)]
