"""The versioned store: equal to a whole upsert, touched shards only, all or nothing, one winner."""
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import incremental as N
from veilspark.sources.store import ArtifactStore, VersionConflict

SCHEMA = "cache_key string, ruleset_version string, sanitized_text string, cached_at long"


def key(i):
    return f"{i % 256:02x}{i:06x}"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return {(r.cache_key, r.ruleset_version): (r.sanitized_text, r.cached_at) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = ArtifactStore(spark, str(tmp_path / "store"))
    s.create(frame(spark, [(key(i), "r", f"old {i}", 10) for i in range(300)]))
    return s


def test_equals_the_whole_upsert(spark, tmp_path):
    rng = random.Random(1)
    for force in (False, True):
        rows = lambda n, tag: list({(k, r): (k, r, f"{tag} {j}", rng.randint(0, 20)) for j in range(n)
                                    for k, r in [(key(rng.randint(0, 60)), rng.choice("rs"))]}.values())
        old, new = frame(spark, rows(80, "old")), frame(spark, rows(50, "new"))
        s = ArtifactStore(spark, str(tmp_path / f"s{force}"))
        s.create(old)
        s.upsert(new, force)
        want = content(N.cache_upsert(old, new, force))
        got = s.read().collect()
        assert len(got) == len(want) and content(s.read()) == want


def test_repeated_new_rows_and_empty_upsert(spark, store):
    v = store.upsert(frame(spark, [(key(1), "r", "a", 11), (key(1), "r", "b", 13), (key(1), "r", "c", 12), (key(2), "r", "d", 9)]))
    got = content(store.read())
    assert got[(key(1), "r")] == ("b", 13) and got[(key(2), "r")] == ("old 2", 10) and len(got) == 300
    assert store.upsert(frame(spark, [])).number == v.number


def test_only_touched_shards_are_read_and_written(spark, store):
    before = store.version()
    new = frame(spark, [(key(3), "r", "new", 20), (key(4), "r", "new", 20)])
    touched = store.shards_of(new)
    assert touched == ["03", "04"]
    # the frame that the merge reads opens files of the two shards alone
    files = store.read_for(new, before).inputFiles()
    assert files and all("shard=03" in f or "shard=04" in f for f in files)
    after = store.upsert(new)
    changed = {s for s in after.shards if after.shards[s] != before.shards.get(s)}
    assert changed == set(touched)
    written = {f for f in store.read(after).inputFiles()} - {f for f in store.read(before).inputFiles()}
    assert written and all("shard=03" in f or "shard=04" in f for f in written)
    # a reader of the old version still has it
    assert content(store.read(before))[(key(3), "r")] == ("old 3", 10)


def test_failed_run_leaves_the_old_version(spark, store):
    before = content(store.read())

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.upsert(frame(spark, [(key(5), "r", "new", 20)]), before_commit=fail)
    assert store.versions() == [1] and content(store.read()) == before
    bad = frame(spark, [(key(5), "r", "new", 20)]).withColumn("sanitized_text", F.raise_error(F.lit("broken input")))
    with pytest.raises(Exception, match="broken input"):
        store.upsert(bad.select(*before and store.read().columns))
    assert store.versions() == [1] and content(store.read()) == before
    store.upsert(frame(spark, [(key(5), "r", "new", 20)]))
    assert content(store.read())[(key(5), "r")] == ("new", 20)


def test_two_writers_cannot_both_win(spark, store):
    other = lambda: store.upsert(frame(spark, [(key(6), "r", "second", 30)]))
    with pytest.raises(VersionConflict):
        store.upsert(frame(spark, [(key(6), "r", "first", 20), (key(7), "r", "first", 20)]), before_commit=other)
    got = content(store.read())
    assert got[(key(6), "r")] == ("second", 30) and got[(key(7), "r")] == ("old 7", 10) and store.versions() == [1, 2]
    # with a retry the first one starts again from what the second one left
    calls = []

    def once():
        if not calls:
            calls.append(1)
            store.upsert(frame(spark, [(key(8), "r", "second", 30)]))

    store.upsert(frame(spark, [(key(8), "r", "first", 20), (key(9), "r", "first", 20)]), before_commit=once, retries=1)
    got = content(store.read())
    assert got[(key(8), "r")] == ("second", 30) and got[(key(9), "r")] == ("first", 20) and store.versions() == [1, 2, 3, 4]


def test_expire(spark, store):
    for k in range(3):
        store.upsert(frame(spark, [(key(10 + k), "r", "new", 20)]))
    before = content(store.read())
    gone = store.expire(keep=1)
    # the first version's folder still holds the untouched shards
    assert store.versions() == [4] and content(store.read()) == before and not gone
    store.upsert(frame(spark, [(key(10), "r", "newer", 30)]))
    assert len(store.expire(keep=1)) == 1 and content(store.read())[(key(10), "r")] == ("newer", 30)


def test_no_text_is_shuffled_for_a_small_upsert(spark, store, capsys):
    from veilspark.sources.store import merge

    merge(store.read(), frame(spark, [(key(1), "r", "x", 20)]), False).explain("simple")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
