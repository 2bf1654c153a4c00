"""Written tables leave nothing but themselves on the disks."""

import time

import pytest

from textloom.llm.storage import written
from textloom.sources.storage import CLEANED, stored


def _shuffles(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("write", [stored, written])
def test_a_written_table_leaves_no_shuffles(spark, write):
    before = _shuffles(spark)
    df = spark.range(5000).repartition(3, "id").groupBy("id").count()
    table = write(df.repartition(3, "count"), "test")
    for _ in range(100):  # they are removed behind the query's end
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 5000 and df.count() == 5000


def test_the_callers_setting_is_put_back(spark):
    assert spark.conf.get(CLEANED) == "false"
    stored(spark.range(3), "test")
    assert spark.conf.get(CLEANED) == "false"
