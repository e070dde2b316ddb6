"""A store kept up to date from changes holds what one written from nothing holds."""

import os
import shutil

from tessera.plans import upkeep
from tessera.plans.store import BUCKETS, Store, sync


def tree_of(root, n):
    for i in range(n):
        place = root / f"area{i % 7}" / f"m{i}.py"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(f"import area{(i + 1) % 7}.m{(i * 5 + 1) % n}\nfrom . import m{i}\n\nclass C{i}:\n    def run(self):\n        return {i}\n")
    (root / "notes.txt").write_text("one")


def rows(df):
    return sorted(map(repr, df.collect()))


def same(spark, store, root, tmp_path, tag):
    new = Store(spark, f"{tmp_path}/fresh-{tag}")
    sync(spark, str(root), new)
    for name in upkeep.MADE:
        assert rows(store.table(name)) == rows(new.table(name).select(store.table(name).columns)), name
    for name in upkeep.OF_EDGES | upkeep.OF_FILES:
        read = lambda s: s.spark.read.parquet(f"{s.path}/tables/{name}")  # noqa: B023, E731
        assert rows(read(store)) == rows(read(new)), name
    assert rows(store.bucketed("facts")) == rows(new.bucketed("facts"))


def stamps(tmp_path, name):
    place = f"{tmp_path}/store/tables/{name}"
    return {b: sorted(os.listdir(f"{place}/{b}")) for b in os.listdir(place) if b.startswith("bucket=")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, f"{tmp_path}/store")
    tree_of(root, 150)
    sync(spark, str(root), store)
    before = {n: stamps(tmp_path, n) for n in upkeep.KEYS}
    assert len(before["files"]) > BUCKETS / 2
    # one file more imports, and has a new class
    (root / "area3/m3.py").write_text("import area5.m5\nimport area1.m1\nclass New:\n    pass\n")
    sync(spark, str(root), store)
    after = {n: stamps(tmp_path, n) for n in upkeep.KEYS}
    written = {n: {b for b in after[n] if after[n][b] != before[n].get(b)} | (set(before[n]) - set(after[n])) for n in upkeep.KEYS}
    assert written["other_files"] == set() and all(len(written[n]) == 1 for n in ("files", "symbols", "scores", "import_edges", "adjacency"))
    ends = ["area3/m3.py", "area4/__init__.py", "area3/__init__.py", "area5/m5.py", "area1/m1.py"]  # itself, and the ends of edges that went and came
    hit = store.buckets(spark.createDataFrame([(x,) for x in ends], "path string"), "path")
    assert sorted(written["reverse"]) == sorted(f"bucket={b}" for b in hit)
    same(spark, store, root, tmp_path, "modified")
    # a file goes that others import, one moves, a package comes that takes over an import, and a file without bytes
    (root / "area1/m1.py").unlink()
    (root / "area2/m2.py").rename(root / "area4/moved.py")
    (root / "area5/m5").mkdir()
    (root / "area5/m5/__init__.py").write_text("")
    (root / "area6/none.py").write_text("")
    (root / "notes.txt").write_text("two")
    sync(spark, str(root), store)
    same(spark, store, root, tmp_path, "moved")


def test_a_run_that_broke_off_is_done_from_nothing(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, f"{tmp_path}/store")
    tree_of(root, 8)
    sync(spark, str(root), store)
    store.begin()
    shutil.rmtree(f"{tmp_path}/store/tables/symbols")
    assert not store.whole()
    assert sync(spark, str(root), store).count() == 0 and store.whole()
    same(spark, store, root, tmp_path, "again")


def test_a_tree_may_lose_all_its_files(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, f"{tmp_path}/store")
    tree_of(root, 3)
    sync(spark, str(root), store)
    for i in range(3):
        shutil.rmtree(root / f"area{i}")
    assert {r.status for r in sync(spark, str(root), store).collect()} == {"deleted"}
    same(spark, store, root, tmp_path, "empty")
