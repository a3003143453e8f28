"""Memory that the driver's allocators hold is given back."""

import re
from pathlib import Path

from thalassa.llm import scratch
from thalassa.llm.components import connected


def _mb(pid: int) -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def _fill(jvm) -> list:
    """Native memory of the JVM, freed but for every fiftieth piece; those are returned."""
    held = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for i, x in enumerate(held):
        if i % 50 != 49:
            x.end()
    return held


def test_freed_memory_of_the_jvm_is_given_back(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    scratch.relieve(spark)
    held = _fill(spark._jvm)
    before = _mb(pid)
    scratch.relieve(spark)
    assert _mb(pid) < before - 30
    assert len(held) == 400


def test_intermediate_tables_give_memory_back_now_and_then(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "relieve", calls.append)
    monkeypatch.setattr(scratch, "_relieved", -float("inf"))
    assert scratch.materialize(spark.range(5)).count() == 5
    assert calls == [spark]


def test_executors_collect_their_garbage_now_and_then(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans())
    before = count()
    with monkeypatch.context() as m:
        # as if it were a cluster: this JVM runs the tasks
        m.setattr(spark.sparkContext, "master", "spark://cluster")
        m.setattr(scratch, "_executors_relieved", -float("inf"))
        assert scratch.materialize(spark.range(5)).count() == 5
        assert scratch._executors_relieved > 0
    assert count() > before
    calls = []
    monkeypatch.setattr(scratch, "relieve_executors", calls.append)
    scratch.materialize(spark.range(5))
    assert not calls


def test_components_of_many_partitions_are_few_files(spark):
    names = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        links = spark.range(300).selectExpr("id a", "id + 1 b").where("b % 3 > 0")
        got = connected(links)
        assert {tuple(r) for r in got.collect()} == {(i, i - i % 3) for i in range(301) if i < 300 or i % 3}
        files = [p.name for p in Path(got._scratch_path.removeprefix("file://")).iterdir() if not p.name.startswith(".")]
        assert len(files) == 1 and files[0].startswith("part-")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
