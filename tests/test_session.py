"""The shared folder comes from the session; nothing falls back to a local one."""

import os
from types import SimpleNamespace

import pytest

import __spark_entry__ as contract
from cartlake.operators.staging import staged
from cartlake.session import remove_run_dirs, run_dir, session_with, shared_dir


def stand_in(folder=None, given=None, master="yarn"):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: given, chosen=[])
    context.setCheckpointDir = context.chosen.append
    values = {"spark.checkpoint.dir": folder}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: values.get(key) or default),
                           sparkContext=context)


def test_configured_folder_is_used():
    spark = stand_in("hdfs://lake/work/")
    assert shared_dir(spark) == "hdfs://lake/work"
    assert run_dir(spark, "x").startswith("hdfs://lake/work/cartlake/app-1/x-")
    assert run_dir(spark, "x") != run_dir(spark, "x")
    assert shared_dir(stand_in(given="hdfs://lake/checkpoints/1")) == "hdfs://lake/checkpoints/1"


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_a_missing_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        shared_dir(stand_in(master=master))


def test_only_the_driver_contract_chooses_a_folder_and_only_in_local_mode():
    local, cluster, given = stand_in(master="local[2]"), stand_in(), stand_in("hdfs://x", master="local[2]")
    for spark in (local, cluster, given):
        contract.with_folder(spark)
    assert len(local.sparkContext.chosen) == 1
    assert not cluster.sparkContext.chosen and not given.sparkContext.chosen


def test_staged_results_can_be_removed(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staged(spark.range(10), "numbers").count() == 10
    work = f"{folder}/cartlake/{spark.sparkContext.applicationId}"
    assert any(name.startswith("numbers-") for name in os.listdir(work))
    stand = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: str(tmp_path)), sparkContext=spark.sparkContext)
    os.makedirs(f"{tmp_path}/cartlake/{spark.sparkContext.applicationId}/old-1")
    assert remove_run_dirs(stand) and not os.listdir(f"{tmp_path}/cartlake")
    assert any(name.startswith("numbers-") for name in os.listdir(work))


def test_a_session_with_other_settings_leaves_the_first_alone(spark):
    other = session_with(spark, {"spark.sql.session.timeZone": "Asia/Tokyo"})
    assert other.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert other.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
