from __future__ import annotations

import os
import pathlib
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from engramlake import session as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, master, conf):
        self.sparkContext, self._conf, self.conf = _Context(master), conf, self

    def get(self, key, default):
        return self._conf.get(key, default)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        S.shared_dir(_Session("spark://host:7077", {}))
    assert S.shared_dir(_Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs://n/ckpt/"})) == "hdfs://n/ckpt"


def test_tables_are_dropped(spark):
    df = S.cut(spark.range(5))
    path = S._TABLES[df].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    S.drop(df, None, spark.range(1))
    assert not os.path.exists(path)


@pytest.mark.parametrize("blocked", ["ahocorasick", "engramlake.llm"])
def test_core_stays_without_the_subpackage_or_its_library(blocked):
    code = (
        f"import sys, warnings; sys.modules[{blocked!r}] = None; warnings.simplefilter('ignore')\n"
        "import __spark_entry__ as e\n"
        "names = e.queries(); assert 'p1_found' in names and 'p2_found' not in names; assert 'p1_found' in e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_cut_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files() -> set[str]:
        return {str(f) for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}

    setting, before = spark.conf.get(S.CLEANUP, None), files()
    rows = spark.range(10_000).withColumn("k", F.col("id") % 97).repartition("k")
    table = S.cut(rows)
    assert spark.conf.get(S.CLEANUP, None) == setting
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and table.count() == 10_000
