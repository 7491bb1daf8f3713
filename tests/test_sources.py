"""Files and tables in and out, and a caller's own functions."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronovox.operators import attribution as A
from chronovox.operators import store as S
from chronovox.sources import tables as T


def test_inventory_of_a_folder(spark, tmp_path):
    files = {"t1/Ann/a.flac": b"x" * 10, "t1/Ann/b.WAV": b"", "t1/Bob Ö/c.mp3": b"yy", "t2/Ann/a.flac": b"x" * 10, "t2/Ann/notes.txt": b"no audio"}
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {(r.tenant_id, r.speaker_name, r.size): r for r in T.scan_inventory(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and {("t1", "Ann", 10), ("t2", "Ann", 10)} < set(got)  # empty files are not listed
    assert got[("t1", "Ann", 10)].content_sha256 == hashlib.sha256(b"x" * 10).hexdigest() == got[("t2", "Ann", 10)].content_sha256
    assert all(r.mtime > 1.5e9 for r in got.values())
    assert "content_sha256" not in T.scan_inventory(spark, str(tmp_path), digest=False).columns


def test_store_by_tenant(spark, tmp_path):
    df = spark.createDataFrame([("a", "Ann", False), ("a", "Eve", True), ("b", "Ann", None)], "tenant_id string, name string, pending boolean")
    T.write_store(df, str(tmp_path / "profiles"))
    names = lambda d: sorted((r.tenant_id, r.name) for r in d.collect())
    assert names(T.read_store(spark, str(tmp_path / "profiles"))) == [("a", "Ann"), ("a", "Eve"), ("b", "Ann")]
    own = T.read_store(spark, str(tmp_path / "profiles"), "a", include_pending=False)
    assert names(own) == [("a", "Ann")]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tenant_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def small_store(spark):
    clip = lambda i, who, t=1, h=None, dur=10.0: (t, i, who, f"s{i % 2}", dur, 1.0 * i, h or f"h{i}", f"/store/{t}/{who}/{i}.flac", None)
    snips = [clip(1, "Ann"), clip(2, "Ann", h="h1"), clip(3, "Ann"), clip(4, "Bob", dur=12.0), clip(5, "Bob", dur=9.0), clip(6, "Eve", t=2), clip(7, "Eve", t=2, h="h6")]
    people = [(1, "Ann", 30.0, False), (1, "Bob", 99.0, False), (2, "Eve", 20.0, False)]
    return {
        "snippets": spark.createDataFrame(snips, "tenant_id int, id long, speaker_name string, source_audio string, duration_sec double, start_sec double, content_sha256 string, file_path string, review_flag boolean"),
        "profiles": spark.createDataFrame(people, "tenant_id int, name string, total_speech_sec double, pending boolean"),
    }


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_store_commits_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path / "store")
    assert T.open_store(spark, root) == {} and T.store_versions(spark, root) == []
    store = small_store(spark)
    assert T.commit_store(spark, root, store) == 1
    one = T.open_store(spark, root)
    assert set(one) == {"snippets", "profiles"} and all(rows_of(one[k]) == rows_of(store[k]) for k in store)
    # the second table fails: the first one's new folder is there, but no version has it
    bad = one["profiles"].withColumn("name", F.expr("raise_error('no disk')").cast("string"))
    with pytest.raises(Exception, match="no disk"):
        T.commit_store(spark, root, {"snippets": one["snippets"].where("id = 1"), "profiles": bad})
    assert T.store_versions(spark, root) == [1] and all(rows_of(T.open_store(spark, root)[k]) == rows_of(store[k]) for k in store)
    # a table computed from itself replaces itself; the other one stays; the old version is still there
    assert T.commit_store(spark, root, {"snippets": one["snippets"].where("id <> 1")}) == 2
    two = T.open_store(spark, root)
    assert two["snippets"].count() == 6 and rows_of(two["profiles"]) == rows_of(store["profiles"]) and T.open_store(spark, root, 1)["snippets"].count() == 7
    with pytest.raises(ValueError):
        T.open_store(spark, root, 9)


def test_cleanup_and_purge_applied(spark, tmp_path):
    """Duplicates and dead clips go and totals follow; a purged tenant is in no table; plans alone change nothing."""
    root = str(tmp_path / "store")
    T.commit_store(spark, root, small_store(spark))
    store = T.open_store(spark, root)
    dead = spark.createDataFrame([(1, 4)], "tenant_id int, id long")
    plan = {(r.tenant_id, r.id): r.reason for r in S.cleanup(store, dead).collect()}
    assert plan == {(1, 2): "duplicate", (1, 4): "dead", (2, 7): "duplicate"}
    assert T.open_store(spark, root)["snippets"].count() == 7
    T.commit_store(spark, root, S.cleanup(store, dead, dry_run=False))
    store = T.open_store(spark, root)
    assert sorted(r.id for r in store["snippets"].collect()) == [1, 3, 5, 6]
    assert {r.name: r.total_speech_sec for r in store["profiles"].collect()} == {"Ann": 20.0, "Bob": 9.0, "Eve": 10.0}
    ids = spark.createDataFrame([(2,), (7,)], "tenant_id int")
    same, counts = S.purge_tenant(store, ids)
    assert sorted((r.tenant_id, r.table, r.rows) for r in counts.collect()) == [(2, "profiles", 1), (2, "snippets", 1), (7, "profiles", 0), (7, "snippets", 0)]
    assert rows_of(same["snippets"]) == rows_of(store["snippets"])
    T.commit_store(spark, root, S.purge_tenant(store, ids, purge=True)[0])
    after = T.open_store(spark, root)
    assert {r.tenant_id for t in after.values() for r in t.select("tenant_id").collect()} == {1} and after["snippets"].count() == 3


def test_exports_are_written(spark, tmp_path):
    r = spark.createDataFrame([(1, 0, 0.0, 1.0, "Ann", "Hi."), (1, 1, 61.5, 62.0, None, "Bye.")], "recording_id int, seq long, start_s double, end_s double, speaker string, text string")
    T.export(A.export_text(r).select("text"), str(tmp_path / "txt"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "txt")).collect())
    assert "[Ann] 00:00:00.000 - 00:00:01.000: Hi." in text and "[UNKNOWN] 00:01:01.500 - 00:01:02.000: Bye." in text
    T.export(A.export_sidecar(r), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_a_callers_own_recogniser(spark):
    def words(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recording_id": frame.recording_id, "text": frame.name.str.upper()})

    got = A.attach_items(spark.createDataFrame([(1, "a"), (2, "b")], "recording_id long, name string"), words, "recording_id long, text string")
    assert sorted((r.recording_id, r.text) for r in got.collect()) == [(1, "A"), (2, "B")]
    assert A.attach_vectors(got.withColumn("name", F.col("text")), words, "recording_id long, text string").count() == 2
