from __future__ import annotations

from types import SimpleNamespace

import pytest

from lumidex.llm import common


def test_saved_tables_can_be_cleaned(spark):
    assert common.saved(spark.range(3).toDF("x"), "mine").count() == 3
    assert common.clean(spark) >= 1 and common.clean(spark) == 0


def test_tables_that_were_replaced_go(spark):
    one, other = common.saved(spark.range(3).toDF("x"), "mine"), common.saved(spark.range(4).toDF("x"), "mine")
    common.forget(one)
    assert other.count() == 4 and common.clean(spark) == 1


def test_a_cluster_without_a_shared_folder_is_refused():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(session)
