import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import packing, pieces

from .conftest import prose


def naive_fit(lengths, size):
    rooms, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(room, r) for r, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            r = min(fits)[1]
        else:
            r = len(rooms)
            rooms.append(size)
            rows.append([])
        rooms[r] -= lengths[k]
        rows[r].append(k)
    return rows


def test_best_fit_equals_naive():
    rng = random.Random(1)
    for size in (7, 64, 100):
        for _ in range(40):
            lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(80))]
            assert packing.best_fit_decreasing(lengths, size) == naive_fit(lengths, size)


def test_packing_loses_nothing(spark, awkward, empty, tmp_path):
    """Every row comes back whole, repeated ones and those without an id too, also through matrix files."""
    packed = packing.pack(awkward, row_tokens=128, pool_tokens=1000)
    rows = packed.collect()
    encode = packing.encoder(packing.VOCABULARY)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 128 and (ids[r.n_tokens :] == encode.free_id).all() and encode.free_id == 50256
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.position_resets == r.cu_seqlens[:-1]
        assert len(r.doc_ids) == len(r.doc_rows) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
    assert len({r.pack_id for r in rows}) == len(rows)
    wanted = sorted((str(r.doc_id), encode(r.text).tolist()) for r in awkward.collect() if r.text)
    assert sorted((str(r.doc_id), r.ids) for r in packing.unpack(packed).collect()) == wanted
    assert all(encode.decode_bytes(ids) == r.text.encode() for r in awkward.collect() if r.text for ids in [encode(r.text).tolist()])
    packing.write_matrices(packed, f"file://{tmp_path}/matrices", row_tokens=128, file_bytes=2000)
    again = packing.read_matrices(spark, f"file://{tmp_path}/matrices")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows)) and len(list(tmp_path.glob("matrices/part-*"))) > 2
    assert packing.pack(empty).count() == 0


def test_ids_that_do_not_fit_are_told(spark, awkward, tmp_path):
    path = tmp_path / "ranks"
    with open(packing.VOCABULARY) as lines:
        path.write_text(lines.read() + "".join(f"{base64.b64encode(f'~~{i}'.encode()).decode()} {70000 + i}\n" for i in range(3)))
    with pytest.raises(Exception, match="do not fit"):
        packing.pack(awkward, str(path)).collect()
    assert packing.pack(awkward, str(path), width=4).count() > 0


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.MODEL)


def scanned(model, text, size):
    chunks = [pieces.Chunk(model, *c[1:]) for c in pieces._chunks(pieces.marked(text), model.longest, size)]
    matrices = [c.matrix() for c in chunks]
    whole = matrices[0]
    for m in matrices[1:]:
        whole = pieces.product(whole, m)
    assert (whole[0] == 0).sum() == 1
    states = [0, *pieces.between(matrices, 0, int(np.argmax(whole[0])))]
    return [i for c, a, z in zip(chunks, states, states[1:]) for i in c.backtrace(a, z)]


def test_scan_equals_library(model):
    rng = random.Random(2)
    texts = ["".join(rng.choice("thereisanode ingx  \n\té漢🙂▁0<>") for _ in range(rng.randrange(1, 700))) for _ in range(60)]
    texts += ["a" * 300, " " * 200, "\n" * 90, "🙂" * 40, " a", " ", "the" * 200, prose(rng, 300).replace(" ", ""), prose(rng, 200)]
    for text in texts:
        for size in (64, 150):
            assert scanned(model, text, size) == model.library.encode(text), text


def test_product_is_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random(s) < 0.4, 0.0, pieces.NEVER) for s in ((3, 5), (5, 4), (4, 6)))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_encode(spark, awkward, empty, model):
    found = pieces.encode(awkward, giant=300, chunk=256).collect()
    texts = [(r.doc_id, r.text or "") for r in awkward.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(i), model.library.encode(t)) for i, t in texts)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    assert {r.n_chunks for r in found if r.doc_id == 10} == {-(-40_001 // 256)}
    assert pieces.encode(empty).count() == 0
    tiny_blocks = pieces.encode_giants(awkward.select("doc_id", "text").where(F.length("text") > 300), chunk=128, block=3)
    assert tiny_blocks.count() == awkward.where(F.length("text") > 300).count()


def test_decode_bytes(model):
    for text in ("", "a", "é\n漢", " two  spaces "):
        assert model.decode(model.library.encode(text)) == text.encode()
