"""Tables in the shared folder are emptied once results are written."""

from tessella.llm import common, linededup, mixing


def test_cleanup_empties_what_is_left(spark, make, tmp_path):
    docs = make([(i, f"line {i}\nshared line", f"s{i % 12}") for i in range(60)])
    mixing.apply_mix(docs).write.parquet(str(tmp_path / "mix"))
    linededup.dedup_lines(docs).write.parquet(str(tmp_path / "lines"))
    left = [t for t in common._written if t.sparkSession is spark]
    assert left and any(t.count() for t in left)
    common.cleanup(spark)
    assert not [t for t in common._written if t.sparkSession is spark]
    assert all(spark.read.schema(t.schema).parquet(t._at).count() == 0 for t in left)
    assert spark.read.parquet(str(tmp_path / "mix")).count() > 0 and spark.read.parquet(str(tmp_path / "lines")).count() == 60
