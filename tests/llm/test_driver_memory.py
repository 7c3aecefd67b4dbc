"""What the driver holds between the jobs of a loop: dropped tables go, broadcasts that nothing reads go, the Jaccard join sees to it."""

import gc
import time
import weakref

from pyspark.sql import functions as F

from gustfield.llm import columnar, jaccard
from tests.llm.test_null_ids import changed, words


def held(spark):
    """Bytes of broadcasts and other blocks in the driver's memory."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore().memoryUsed()


def test_dropped_tables_are_not_held(spark):
    scratch = columnar.Scratch(spark, "held")
    first, second = scratch.write(spark.range(3), "t"), scratch.write(spark.range(5), "t")
    gone = weakref.ref(first)
    scratch.drop(first)
    third = scratch.write(spark.range(7), "t")  # no name comes twice
    assert (second.count(), third.count()) == (5, 7)
    del first
    gc.collect()
    assert gone() is None


def test_join_gives_up_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    base = words(5)
    texts = [changed(base, *range(i, i + 40, 6)) for i in range(0, 150, 3)] + [" ".join(words(i)) for i in range(100, 130)]
    docs = columnar.written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "docs")
    columnar.forget(spark)
    time.sleep(2)
    before, seen, own = held(spark), [], columnar.forget

    def forget(session):
        big = session.range(1 << 16).withColumn("v", F.col("id") * 3)
        session.range(10).join(F.broadcast(big), "id").write.format("noop").mode("overwrite").save()  # as the map of may_be
        del big
        full = held(session)
        own(session)
        until = time.time() + 5
        while held(session) > before + (full - before) / 2 and time.time() < until:
            time.sleep(0.1)
        seen.append((full - before, held(session) - before))

    monkeypatch.setattr(columnar, "forget", forget)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {i: c for i, (_, c) in enumerate(jaccard.brute_force(texts))}
    assert len(seen) >= 3 and seen[-1][1] <= seen[-1][0] / 2, seen  # what is still read stays
