from tessera.operators import extract
from tessera.plans.store import FACT, Store, debt, new_code, stored_impact, sync

FUNCTION = "def f(a):\n    b = a + 1\n    c = b\n    return c\n"


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_sync_again_and_again(spark, tmp_path):
    root, store, folder = tmp_path / "tree", Store(spark, f"{tmp_path}/store"), str(tmp_path / "kb")
    put(root, {"p/a.py": FUNCTION, "p/b.py": "import p.a\n", "x.py": "1\n"})
    store.describe("p/a.py", "first")
    store.describe("p/none.py", "gone")
    store.describe("p/none.py", None)
    rows = lambda df: sorted((r.path, r.status, r.old_path) for r in df.collect())
    assert [s for _, s, _ in rows(sync(spark, str(root), store, folder=folder))] == ["added"] * 3
    assert rows(sync(spark, str(root), store)) == []
    (root / "p/a.py").rename(root / "p/moved.py")
    put(root, {"q/new.py": FUNCTION.replace("def f", "# TODO\ndef f"), "x.py": "2\n"})
    before = store.read("facts", FACT).count()
    diff = sync(spark, str(root), store, folder=folder)
    assert rows(diff) == [("p/moved.py", "moved", "p/a.py"), ("q/new.py", "added", None), ("x.py", "modified", None)]
    assert {r.path: r.description for r in store.descriptions().collect()} == {"p/moved.py": "first"}
    assert before == 3 and store.read("facts", FACT).filter(f"version = '{extract.VERSION}'").count() == 4
    areas, twins = new_code(spark, str(root), store, diff)
    assert [r.area for r in areas.collect()] == ["q"] and twins.count() == 1
    assert sorted((r.added, r.moved, r.modified) for r in store.history(9).collect()) == [(0, 0, 0), (1, 1, 1), (3, 0, 0)]
    assert (tmp_path / "kb/subsystems/q.md").exists() and (tmp_path / "kb/meta.draft.json").exists()
    put(root, {"p/back.py": "import p.b\n"})
    sync(spark, str(root), store)
    assert sorted((r.role, r.node) for r in stored_impact(store, "p/b.py").collect()) == [("dependency", "p/__init__.py"), ("dependent", "p/back.py")]
    debt(spark, str(root), store)
    assert spark.read.parquet(f"{tmp_path}/store/tables/fix_tags").first().tag == "TODO"
    store.as_json("cycles", spark.read.parquet(f"{tmp_path}/store/tables/cycles"))
    old = tmp_path / "kb/subsystems/old.md"
    old.write_text("stale")
    sync(spark, str(root), store, folder=folder)
    assert not old.exists()


def test_a_run_leaves_no_scratch(spark, tmp_path):
    from tessera.plans import tables

    root, store = tmp_path / "tree", Store(spark, f"{tmp_path}/store")
    put(root, {"p/a.py": FUNCTION, "p/b.py": "import p.a\n" + FUNCTION})
    place = tables.shared_folder(spark).removeprefix("file:").replace("//", "/") + "/tables"
    seen = lambda: set(__import__("os").listdir(place)) if __import__("os").path.isdir(place) else set()
    before = seen()
    diff = sync(spark, str(root), store, folder=str(tmp_path / "kb"))
    debt(spark, str(root), store)
    assert seen() == before
    assert sorted(r.status for r in diff.collect()) == ["added", "added"] and store.changes(0).count() == 2
    assert spark.read.parquet(f"{tmp_path}/store/tables/twin_members").count() == 2
