import random

import corpus_pipeline

from .conftest import frame, prose


def article(rng):
    return ".\n".join(prose(rng, 40) + ", and so it ended" for _ in range(4)) + "."


def test_pipeline(spark, awkward, empty, tmp_path):
    rng = random.Random(11)
    item = "What makes the river wander about so? It follows the softest clay of all."
    rows = [(i, article(rng), "en") for i in range(40)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " More.", "en")]  # copies
    rows += [(102, article(rng) + " " + item, "en")]  # a leak
    rows += [(103, article(rng) + " Write to some.one@host.org or call +1 555 123 4567 now.", "en")]
    rows += [(104, " ".join(w + "### %%%" for w in prose(rng, 80).split()), "en"), (105, "short", "en"), (106, None, "en"), (107, "", "en")]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            last = {r.doc_id: r for r in out.collect()}
    assert set(kept["quality_rules"]) == set(range(40)) | {100, 101, 102, 103}
    assert set(kept["near_duplicates"]) == set(range(40)) | {102, 103}
    assert set(kept["decontamination"]) == set(range(40)) | {103}
    changed = {i for i, t in kept["personal_data"].items() if t != kept["decontamination"][i]}
    assert changed == {103} and "<EMAIL>" in kept["personal_data"][103] and "<PHONE>" in kept["personal_data"][103]
    assert set(last) == set(kept["personal_data"]) and all(r.round_trip for r in last.values())
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.ids for i, r in last.items()}


def test_stages_take_anything(spark, awkward, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, str(tmp_path)).count() == 0
        assert function(spark, awkward, str(tmp_path)).count() <= awkward.count()
