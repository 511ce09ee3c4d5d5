"""Writers and readers of many small files: a file for each row and nothing else, many of them to a batch."""

from pyspark.sql import functions as F

from lectern.sources import files as S
from lectern.sources import named as N


def found(folder):
    return {p.relative_to(folder).as_posix(): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_transcripts_are_read_as_bytes(spark, tmp_path):
    whole = "a\r\nb\n\nü"
    (tmp_path / "sub").mkdir()
    for name in ("transcription-1.txt", "sub/transcription 2%20.srt", "._transcription-3.txt", "notes.txt"):
        (tmp_path / name).write_bytes(whole.encode())
    rows = S.read_transcripts(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in rows.collect()} == {("transcription-1.txt", whole), ("transcription%202%2520.srt", whole)}
    assert "binaryfile" in rows._jdf.queryExecution().executedPlan().toString().lower()


def test_local_transcripts_share_tasks(spark, tmp_path):
    names = [f"sub/transcription-{i}.txt" for i in range(600)] + ["transcription 2%20ü [1]{^}.srt", "_h/transcription-1.txt", "_k=v/transcription-1.txt", "transcription-.trt"]
    for folder in ("sub", "_h", "_k=v"):
        (tmp_path / folder).mkdir()
    for name in names:
        (tmp_path / name).write_bytes(b"x\r\n\xff")
    local, other = (S.read_transcripts(spark, prefix + str(tmp_path)) for prefix in ("file://", ""))
    assert sorted(map(tuple, local.collect())) == sorted(map(tuple, other.collect())) and local.count() == 602
    assert local.rdd.getNumPartitions() == 1
    (tmp_path / "transcription-empty.txt").touch()
    assert S.read_transcripts(spark, f"file://{tmp_path}").where("text = ''").count() == 1


def test_named_files_come_in_batches(spark, tmp_path):
    rows = spark.range(N.PARTITION_FILES + 1).select(F.concat(F.col("id") % 7, F.lit("/"), "id").alias("name"), F.col("id").cast("string").alias("content"))
    N.write_named(rows, str(tmp_path / "out"))
    reader = N.NamedReader(str(tmp_path / "out"), "*", False)
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [N.PARTITION_FILES, 1]
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) == N.PARTITION_FILES // N._BATCH_FILES + 1
    read = {(n, c) for b in batches for n, c in zip(b.column("name").to_pylist(), b.column("content").to_pylist())}
    assert read == {(f"{i % 7}/{i}", str(i)) for i in range(N.PARTITION_FILES + 1)}


def test_one_file_a_text_below_its_language(spark, tmp_path):
    texts = spark.createDataFrame([("1", "en", "x\n"), ("1", "de", "y"), ("a/b", "en", ""), ("2", None, "z")], "stem string, lang string, body string")
    S.write_by_language(texts, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {"en/1_en": "x\n", "de/1_de": "y", "en/a%2Fb_en": "", "%null/2": "z"}


def test_one_file_a_document(spark, tmp_path):
    keys = ["d", "a/b", "a%2Fb", ".x", "_y", "..", "%null", "%empty", "ü ä=1", "", None]
    docs = spark.createDataFrame([(k, f"# {k}\n") for k in keys], "doc string, body string")
    S.write_documents(docs, str(tmp_path / "out"), "doc", "body")
    files = found(tmp_path / "out")
    assert len(files) == len(keys) and files["d"] == "# d\n" and not any(name.startswith((".", "_")) for name in files)
    read = N.read_named(spark, str(tmp_path / "out")).select(S.key_of(F.col("name")).alias("doc"), "content").collect()
    assert sorted(map(str, read)) == sorted(map(str, docs.select("doc", F.col("body").alias("content")).collect()))
