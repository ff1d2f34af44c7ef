"""What plans must keep to on large and uneven tables."""

import random
import subprocess
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.operators.ordinals import numbered, time_bucket
from cuelattice.session import NoSharedFolder, cut_lineage, drop_cuts, dropping_cuts, shared_folder, spread

ROOT = Path(__file__).resolve().parent.parent


def test_numbers_equal_a_whole_sort(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 9), round(rng.uniform(0, 9000), 1) if rng.random() < 0.95 else None, i) for i in range(3000)] + [(None, 1.0, -1)]
    frame = spark.createDataFrame(rows, "video_id long, start_s double, i int")
    got = numbered(frame, "n", "video_id", time_bucket("start_s"), ["start_s", "i"])
    want = frame.withColumn("n", F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "i")))
    assert sorted(map(repr, got.select("video_id", "i", "n").collect())) == sorted(map(repr, want.select("video_id", "i", "n").collect()))


def test_cut_lineage_reads_a_table(spark):
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert cut.count() == 10 and "FileScan parquet" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut_lineage(spark.range(0)).count() == 0


def test_cut_tables_can_be_dropped(spark):
    cut = cut_lineage(spark.range(3))
    path = Path(cut.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and drop_cuts(spark) >= 1 and not path.exists() and drop_cuts(spark) == 0


def test_only_cuts_made_inside_are_dropped(spark):
    before = cut_lineage(spark.range(4))
    with dropping_cuts(spark):
        path = Path(cut_lineage(spark.range(3)).inputFiles()[0].removeprefix("file://")).parent
    assert not path.exists() and before.count() == 4


@pytest.mark.parametrize("master, named, found", [("local[4]", None, "spark-warehouse/checkpoints"), ("local[*]", "hdfs://x/y/", "hdfs://x/y"), ("spark://h:7077", "s3a://b/c", "s3a://b/c"), ("spark://h:7077", None, None), ("local-cluster[3,2,1024]", None, None), ("yarn", None, None)])
def test_clusters_must_name_a_shared_folder(master, named, found):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    if found is None:
        with pytest.raises(NoSharedFolder):
            shared_folder(session)
    else:
        assert shared_folder(session).endswith(found)


def test_spread_moves_only_scans_of_few_files(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = one.groupBy("id").count()
    assert spread(shuffled) is shuffled


def test_sources_keep_the_rules():
    text = "\n".join(p.read_text(encoding="utf-8") for p in (ROOT / "cuelattice").rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text
    outside = [p for p in (ROOT / "cuelattice").rglob("*.py") if "llm" not in p.relative_to(ROOT / "cuelattice").parts]
    assert not [p for p in outside if "cuelattice.llm" in p.read_text(encoding="utf-8")]


def test_package_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "cuelattice"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "cuelattice" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'track_events' in q and not [k for k in q if k[:2] == 'p1']; print(len(q))"
    done = subprocess.run(["python", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": __import__("os").environ["PATH"], "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
