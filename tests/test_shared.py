import os
from pathlib import Path

from corpusmill.shared import CLEANUP, scratch, shared_dir, shared_root, written


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirs() for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP)
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(4, "id").groupBy("k").count()
    assert sorted(r["count"] for r in written(df).collect()) == [142] + [143] * 6
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) == setting
    assert df.count() == 7  # can be run again


def test_scratch_is_removed_but_for_results(spark):
    root = Path(shared_root(spark).removeprefix("file://"))
    before, path = set(root.iterdir()), f"{shared_dir(spark)}/result"
    with scratch(spark):
        inner = f"{shared_dir(spark)}/inner"
        with scratch(spark):
            low = written(spark.range(10).where("id > 6"), inner)
        result = written(low.selectExpr("id + 1 AS n"), path)
    assert sorted(r["n"] for r in result.collect()) == [8, 9, 10]
    assert [f"{p}/result" for p in set(root.iterdir()) - before] == [path.removeprefix("file://")]


def test_scratch_is_removed_after_an_error(spark):
    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    try:
        with scratch(spark):
            written(spark.range(3))
            raise KeyError("x")
    except KeyError:
        pass
    assert set(root.iterdir()) == before


def test_setting_is_put_back_by_the_last_of_several_threads(spark):
    from threading import Thread

    setting, got = spark.conf.get(CLEANUP), []
    run = lambda k: got.append(written(spark.range(200).repartition(3).selectExpr(f"id + {k} AS n")).count())
    threads = [Thread(target=run, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [200] * 6
    assert spark.conf.get(CLEANUP) == setting


def test_which_sessions_may_lack_a_shared_folder():
    import re

    import pytest

    class Fake:
        def __init__(self, master):
            self.master, self.set_to = master, None
            self.conf = self.sparkContext = self

        def get(self, key, default):
            return default

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, to):
            self.set_to = to

    for master in ("local", "local[3]", "local[*]"):
        assert re.match("file:///", shared_root(Fake(master)))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077", "locally"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_root(Fake(master))
