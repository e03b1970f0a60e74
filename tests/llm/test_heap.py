"""What steps leave in the driver's heap while their session goes on."""

from postlake.llm import common as C


def test_a_cut_of_a_grown_heap_collects_the_drivers_garbage(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(C, "HEAP_SHARE", 0.0, raising=False)
    before = full()
    assert C.cut(spark.range(10)).count() == 10
    assert full() > before
    # While the heap is small, nothing is collected.
    monkeypatch.setattr(C, "HEAP_SHARE", 2.0, raising=False)
    before = full()
    assert C.cut(spark.range(10)).count() == 10
    assert full() == before
