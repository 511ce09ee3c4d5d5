"""Transcripts of any document against their SQL, and listings of many files."""

import tracemalloc

import duckdb
import pytest
from pyarrow import fs

from lectern.plans import library2, queries
from lectern.sources import named as N

ODD = [None, "", "a b", "a+b", "a/b", "a%2Fb", "100%", ".x", "_y", "k=v", "ü#?[1]", "%null", "text"]


def both(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/sf/documents.parquet")
    found = queries.queries()["s4_read_transcripts"](spark, f"{folder}/sf").select("name", "text").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/sf/documents.parquet/*.parquet'")
    wanted = con.sql("SELECT name, text FROM (" + queries.oracle_sql()["s4_read_transcripts"] + ")").fetchall()
    return sorted(map(repr, map(tuple, found))), sorted(map(repr, wanted))


@pytest.mark.parametrize("kind", ["no text", "empty text", "no language", "signs", "no number", "negative number"])
@pytest.mark.parametrize("scheme", ["file://", ""])
def test_transcripts_of_odd_documents(spark, tmp_path, monkeypatch, scheme, kind):
    monkeypatch.setattr(library2, "_folder", lambda _, tag: f"{scheme}{tmp_path}/{tag}")
    rows = [(i, "x\r\ny\x00ü\n", "en", "src") for i in range(14)]
    rows += {
        "no text": [(16, None, "en", "src"), (17, "", "en", "src")], "empty text": [(16, "", "en", "src")], "no language": [(16, "x", None, "src"), (17, "y", "en", None)],
        "signs": [(16 + 7 * i + k, "x", a, ODD[i * k % 13]) for i, a in enumerate(ODD) for k in (1, 5)], "no number": [(None, "x", "en", "src"), (None, "y", "en", "src")],
        "negative number": [(-k, "x", "en", "src") for k in range(1, 8)],
    }[kind]
    found, wanted = both(spark, tmp_path, rows)
    assert found == wanted and len(wanted) >= 10


def test_listing_keeps_few_bytes_a_file(tmp_path):
    for k in range(3):
        (tmp_path / f"src{k}" / "en").mkdir(parents=True)
        for i in range(10_000):
            (tmp_path / f"src{k}" / "en" / f"transcription-{i}.txt").touch()
    reader = N.NamedReader(f"file://{tmp_path}", "transcription*", True)
    tracemalloc.start()
    try:
        parts = reader.partitions()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 << 20
    assert {p for part in parts for p in part.paths} == {f"{tmp_path}/src{k}/en/transcription-{i}.txt" for k in range(3) for i in range(10_000)}


def test_listing_leaves_out_pending_folders_alone(tmp_path, monkeypatch):
    names = {"a", "b_pending-1", "c/_pending-2", "_pending-3/d", "c/e f/g"}
    for name in names | {f"_pending-{'0' * 32}/k/0", f"c/_pending-{'f' * 32}/k/names"}:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    listed = lambda path: {(p.removeprefix(f"{tmp_path}/")) for part in N.NamedReader(path, "*", False).partitions() for p in part.paths}
    assert listed(f"{tmp_path}/") == listed(f"file:{tmp_path}") == names
    assert listed(f"{tmp_path}/nothing") == set()
    # as in a store whose listings are not a stream
    store = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    monkeypatch.setattr(N, "_opened", lambda path: (store, path))
    assert listed(str(tmp_path)) == names
