import io
import json

import numpy as np
import pytest
from helpers import vectors

from shoal.session import scratch_path
from shoal.sources import npy, schemas, tables
from shoal.sources.json_arrays import read_array, read_objects


def question(i):
    odd = ['plain', 'a } brace', '{"not": "nested"}', 'quote \\" and slash \\\\', 'é 标题 \n }{', '', '}}}', '\\', '"', '[{', '\\"}']
    return {"question_id": i, "title": odd[i % len(odd)], "body": odd[(i // 3) % len(odd)] * (i % 4), "comments": [{"body": odd[(i * 7) % len(odd)]}] * (i % 3),
            "answers": [{"body": odd[(i + j) % len(odd)], "comments": [{"body": "{"}]} for j in range(i % 3)]}


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_in_parallel(spark, tmp_path, indent):
    rows = [question(i) for i in range(900)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:600], indent=indent, ensure_ascii=indent is None))
    (tmp_path / "b.json").write_text("  " + json.dumps(rows[600:], indent=indent) + "\n\n")
    (tmp_path / "empty.json").write_text("[ ]\n")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 8
        objects = read_objects(spark, str(tmp_path)).collect()
        got = {r["file"].rsplit("/", 1)[-1][0]: [] for r in objects}
        for r in sorted(objects, key=lambda r: (r["file"], r["number"])):
            got[r["file"].rsplit("/", 1)[-1][0]].append((r["number"], json.loads(r["text"])))
        assert got == {"a": list(enumerate(rows[:600])), "b": list(enumerate(rows[600:]))}
        parsed = {r.question_id: r.asDict(True) for r in read_array(spark, str(tmp_path), schemas.CORPUS).collect()}
        assert parsed == {r["question_id"]: r for r in rows}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_one_long_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question_id": 1, "title": "}\"{" * 50_000, "body": "b"}]))
    row = read_array(spark, str(tmp_path / "a.json"), schemas.CORPUS).collect()[0]
    assert row.title == "}\"{" * 50_000
    assert tables.read_corpus(spark, str(tmp_path / "a.json"), array=True).count() == 1


def saved_npy(x):
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


@pytest.mark.parametrize("kind, order", [("<f4", "C"), ("<f8", "C"), (">f8", "C"), ("<f4", "F"), ("<f8", "F")])
def test_npy_is_read_by_row_ranges(spark, tmp_path, kind, order):
    x = np.random.default_rng(0).normal(size=(1000, 7)).astype(kind)
    path = tmp_path / "x.npy"
    path.write_bytes(saved_npy(np.asarray(x, order=order)))
    table = npy.read_npy(spark, str(path), row_bytes=2000)
    assert table.rdd.getNumPartitions() > 8
    got = {r.id: r.vec for r in table.collect()}
    assert sorted(got) == list(range(1000)) and all(np.array_equal(got[i], x[i].astype(float)) for i in got)


def test_npy_parts_are_one_matrix(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(500, 5))
    folder = scratch_path(spark, "npy")
    monkeypatch.setattr(npy, "ROW_BYTES", 5 * 8 * 64)
    rows = vectors(spark, x).selectExpr("id * 10 - 7 AS id", "vec").repartition(5)
    parts = npy.write_npy(rows, folder, "f8").orderBy("part").collect()
    assert [r.rows for r in parts] == [64] * 7 + [52] and [r.first_row for r in parts] == list(range(0, 500, 64))
    loaded = np.vstack([np.load(r.path.removeprefix("file:")) for r in parts])
    assert np.array_equal(loaded, x)
    got = {r.id: r.vec for r in npy.read_npy(spark, folder).collect()}
    assert all(np.array_equal(got[i], x[i]) for i in range(500)) and len(got) == 500


def test_odd_npy_files(spark, tmp_path):
    for name, x in (("flat", np.arange(4.0)), ("none", np.zeros((0, 3), np.float32))):
        (tmp_path / f"{name}.npy").write_bytes(saved_npy(x))
    assert sorted(tuple(r.vec) for r in npy.read_npy(spark, str(tmp_path / "flat.npy")).collect()) == [(0.0,), (1.0,), (2.0,), (3.0,)]
    assert npy.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "bad.npy").write_bytes(b"nothing here")
    (tmp_path / "ints.npy").write_bytes(saved_npy(np.arange(4)))
    for name in ("bad", "ints"):
        with pytest.raises(ValueError):
            npy.read_npy(spark, str(tmp_path / f"{name}.npy"))
