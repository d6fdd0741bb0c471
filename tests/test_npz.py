import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmend.operators import sieve
from pairmend.sources.npz import NpzSource


@pytest.fixture(scope="module")
def npz(spark):
    spark.dataSource.register(NpzSource)
    return spark


def test_export_goes_to_archives_and_back(npz, tmp_path):
    rows = npz.range(1000).selectExpr("concat('é', id) AS row_id", "IF(id % 7 = 0, NULL, array(id / 3D, id / 7D)) AS text_emb", "array(1D, double(id)) AS image_emb", "IF(id % 5 = 0, NULL, id / 10D) AS sim_score", "0.5D AS sieve_threshold", "id % 3 = 0 AS flagged")
    export = sieve.export_embeddings(rows, 4)
    export.repartition(3).write.format("npz").mode("overwrite").save(str(tmp_path / "cache"))
    files = sorted(x.name for x in (tmp_path / "cache").iterdir())
    assert files == [f"part-{k:05d}.npz" for k in range(3)]
    back = npz.read.format("npz").option("rows", 100).load(str(tmp_path / "cache"))
    assert back.rdd.getNumPartitions() == 12 and back.columns == export.columns
    same = back.select([F.col(c).cast(k) for c, k in export.dtypes])
    assert same.exceptAll(export).isEmpty() and export.exceptAll(same).isEmpty()
    with np.load(tmp_path / "cache" / files[0]) as one:
        assert one["text_emb"].shape[1] == 4 and one["row_id"].dtype.kind == "U"
    export.limit(10).coalesce(1).write.format("npz").mode("overwrite").save(str(tmp_path / "cache"))
    assert npz.read.format("npz").load(str(tmp_path / "cache")).count() == 10


def test_compressed_archives_and_other_kinds(npz, tmp_path):
    path = tmp_path / "one.npz"
    np.savez_compressed(path, row_id=np.array(["a", "bcd", ""]), v=np.arange(6, dtype=np.float32).reshape(3, 2), n=np.array([1, 2, 3], np.int32), ok=np.array([True, False, True]))
    got = npz.read.format("npz").option("rows", 2).load(str(path))
    assert got.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in got.orderBy("n").collect()] == [("a", [0.0, 1.0], 1, True), ("bcd", [2.0, 3.0], 2, False), ("", [4.0, 5.0], 3, True)]
    np.savez(tmp_path / "bad.npz", a=np.arange(3), b=np.arange(4))
    with pytest.raises(Exception, match="different lengths"):
        npz.read.format("npz").load(str(tmp_path / "bad.npz")).count()
    with pytest.raises(Exception, match="null"):
        npz.sql("SELECT CAST(NULL AS STRING) AS a").write.format("npz").mode("overwrite").save(str(tmp_path / "x"))
