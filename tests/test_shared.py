"""Tables in the shared folder."""

import os
import threading

from pyspark.sql import functions as F

from plumbline.operators.policy import small
from plumbline.sources.shared import keep, scratch


def test_a_table_of_few_long_rows_is_not_broadcast(spark):
    hinted = lambda df: "Broadcast" in df._jdf.queryExecution().logical().toString() or "broadcast" in df._jdf.queryExecution().logical().toString()
    df = spark.range(10).withColumns({"m": F.create_map(F.lit("k"), F.lit("v" * 200)), "none": F.lit(None).cast("string")})
    assert hinted(small(df)) and not hinted(small(df, limit=9)) and not hinted(small(df, most_bytes=1000))
    assert hinted(small(df.limit(0)))


def test_a_scratch_removes_what_its_own_thread_kept(spark):
    inside, done, paths = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark):
            paths["other"] = keep(spark.range(3), "other").inputFiles()[0]
            inside.set()
            done.wait(60)
        paths["gone"] = not os.path.exists(paths["other"].removeprefix("file://"))

    with scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        inside.wait(60)
        own = keep(spark.range(3), "own").inputFiles()[0].removeprefix("file://")
        stays = keep(spark.range(3), "stays", stays=True).inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(own) and os.path.exists(stays) and os.path.exists(paths["other"].removeprefix("file://"))
    done.set()
    thread.join()
    assert paths["gone"]
