"""What stages leave in the memory of executors and of their Python workers."""

import tracemalloc

import corpus_pipeline
import numpy as np
from weftspan.llm import _shared, quality_model


def test_word_vectors_take_little_memory_at_once():
    words = [b"word%07d" % k for k in range(60_000)]
    table = np.random.default_rng(1).random((quality_model.BUCKETS, quality_model.WIDTH)).astype(np.float32)
    tracemalloc.start()
    whole = quality_model.word_vectors(words, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    assert np.array_equal(whole[-3:], quality_model.word_vectors(words[-3:], table))


def test_a_worker_gives_memory_back_when_its_task_ends(monkeypatch):
    done = []
    monkeypatch.setattr(_shared, "give_back", lambda: done.append(1))
    assert list(_shared.lean(iter)([1, 2])) == [1, 2] and done == [1]
    early = _shared.lean(iter)([1, 2])
    assert next(early) == 1
    early.close()
    assert done == [1, 1]


def test_stages_begin_with_collected_executors(spark):
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "Mark" in b.getName())
    before = full()
    docs = spark.createDataFrame([(1, "write to a@b.example"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in corpus_pipeline.masked(spark, docs, "").orderBy("doc_id").collect()] == ["write to [EMAIL]", None]
    assert full() > before
