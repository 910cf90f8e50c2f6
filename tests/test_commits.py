"""Commits of the store: two writers, torn saves, readers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from palimpsest.memory import Memory
from palimpsest.sources import store as Store


def test_of_two_writers_of_one_version_one_succeeds(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one = spark.createDataFrame([(1, "a")], "id int, user_id string")
    version = Store.save(spark, root, {"facts": one})["version"]

    def write(i):
        try:
            return Store.save(spark, root, {"facts": one.withColumn("id", one.id + i)}, expected=version)["version"]
        except ValueError:
            return None

    for _ in range(2):
        with ThreadPoolExecutor(4) as pool:
            made = [v for v in pool.map(write, range(4)) if v]
        assert len(made) == 1 and Store.current_version(spark, root) == made[0]
        version = made[0]
    assert Store.load(spark, root)["facts"].count() == 1


def test_a_commit_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/c/000000000001.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: Store._create_new(spark, path, f"writer {i}"), range(24)))
    assert sum(made) == 1 and (tmp_path / "c/000000000001.json").read_text() == f"writer {made.index(True)}"
    assert [p.name for p in (tmp_path / "c").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_a_torn_save_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/m"
    m = Memory(spark)
    m.save(root)
    m.add_fact("Wei", "likes", "tea", "u", 1.0)
    with monkeypatch.context() as p:
        p.setattr(Store, "_create_new", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            m.save(root)
    assert Memory.open(spark, root).facts.isEmpty() and not m.stale(root)
    m.save(root)
    assert Memory.open(spark, root).facts.count() == 1
    late = Memory.open(spark, root)
    m.save(root)
    assert late.stale(root)
    with pytest.raises(ValueError):
        late.save(root)
