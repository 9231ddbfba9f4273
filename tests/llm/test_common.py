import os

from lectern.llm import common


def test_cut_tables_are_swept(spark):
    rows = common.cut(spark.range(3), "sweep")
    assert rows.count() == 3 and rows.dtypes == spark.range(3).dtypes
    path = common._written[-1].removeprefix("file:")
    assert os.path.isdir(path)
    common.sweep(spark)
    assert not os.path.isdir(path) and common._written == []


def test_words():
    assert [w.decode() for w in common.words("It's 42, É日本_x\x00Y")] == ["it", "s", "42", "É日本", "x", "y"]
    assert common.words(None) == [] and common.words("...") == []


def test_split_words_agrees(spark):
    texts = ["It's 42, x_y", "", "...", " a", "a ", ". a b.", None, "Éa é", "日本 語,x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in common.split_words(rows, "t", "w").collect()}
    assert [len(got[i]) for i in range(len(texts))] == [len(common.words(t)) for t in texts]
    assert got[0] == ["it", "s", "42", "x", "y"] and got[5] == ["a", "b"]


def test_batches_are_cut(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100})
    parts = list(common.pieces(batch, 10_000))
    assert sum(p.num_rows for p in parts) == 100 and len(parts) >= 10
    assert list(common.pieces(batch.slice(0, 0))) == []
