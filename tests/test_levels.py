"""Folders of micro-batches put together by levels."""

import math
from collections import Counter

from pyspark.sql import functions as F

from weir.store import Store, level_of


def test_rows_are_written_again_a_logarithm_of_times(spark, tmp_path, monkeypatch):
    store, fan, n = Store(spark, str(tmp_path)), 3, 30
    written = Counter()
    put = store._put

    def counted(table, rows):
        put(table, rows)
        written.update(r.number for r in rows.select("number").collect())

    monkeypatch.setattr(store, "_put", counted)
    most = 0
    for number in range(n):
        store.write("spans", spark.range(1).select(F.lit(5).cast("long").alias("request_us"), F.lit(number).alias("number")), number)
        store.tidy("spans", {0}, fan=fan, grace_s=0)
        most = max(most, len(list(store._folders("spans"))))
        assert sorted(r.number for r in store.read("spans").collect()) == list(range(number + 1))
    assert max(written.values()) <= 1 + math.log(n, fan) and most <= fan * (1 + math.log(n, fan))
    store.write("spans", spark.range(1).select(F.lit(5).cast("long").alias("request_us"), F.lit(99).alias("number")), 4)  # done again, though it is in a higher level
    store.refresh()
    assert 99 not in {r.number for r in store.read("spans").collect()} and store.compact("spans") > 0
    assert sorted(r.number for r in store.read("spans").collect()) == list(range(n)) and len(list(store._folders("spans"))) == 1


def test_readers_see_the_old_folders_until_the_mark_is_there(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    for number in range(4):
        store.write("spans", spark.range(1).select(F.lit(5).cast("long").alias("request_us"), F.lit(number).alias("number")), number)
    before = store.read("spans")
    with monkeypatch.context() as m:
        m.setattr(store, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            store.tidy("spans", fan=4)
        except RuntimeError:
            pass
    store.refresh()
    assert sum(level_of(b)[0] for _, _, _, b in store._folders("spans")) == 1  # written, without its mark
    assert sorted(r.number for r in store.read("spans").collect()) == [0, 1, 2, 3]
    assert store.tidy("spans", fan=4) == 1 and len(list(store._folders("spans"))) == 5
    # what a reader has open is still there, and new readers take the new folder alone
    assert sorted(r.number for r in before.collect()) == sorted(r.number for r in store.read("spans").collect()) == [0, 1, 2, 3]
    assert len(store.read("spans").inputFiles()) and store._sweep("spans", 0) == 4 and store.read("spans").count() == 4
