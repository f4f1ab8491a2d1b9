"""The versioned store, its journal and recovery, the indexes, streams and the session object."""

import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine, EngineError
from factloom.operators import index
from factloom.sources import store
from factloom.streaming import ingest


def records(spark, *rows):
    return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], store.RECORD)


def test_commits_conflicts_and_snapshots(spark, tmp_path):
    kept = store.VersionedStore(spark, str(tmp_path / "s"))
    assert kept.current() == 0 and kept.state().count() == 0
    one = kept.commit(records(spark, ("entity", "a", "1", "created"), ("entity", "b", "1", "created")), 0)
    pinned = kept.snapshot()
    with pytest.raises(store.ConflictError):
        kept.commit(records(spark, ("entity", "a", "x", "updated")), 0)
    kept.commit(records(spark, ("entity", "a", "2", "retracted")), one)
    assert {x.id: (x.content, x.change) for x in kept.state().collect()} == {"a": ("2", "retracted"), "b": ("1", "created")}
    assert pinned.read().where("id = 'a'").first().content == "1" and not pinned.contains("entity", "zz")
    assert kept.read("entity", "a").first().content == "2"
    before = sorted(map(tuple, kept.state().select("id", "content").collect()))
    assert kept.compact() == 3 and sorted(map(tuple, kept.state().select("id", "content").collect())) == before


def test_a_hundred_records_survive_a_restart_and_stale_files_go(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = [("entity", f"word-{i}", f"payload {i}", "created") for i in range(100)]
    store.VersionedStore(spark, root).commit(records(spark, *rows), 0)
    again = store.VersionedStore(spark, root)
    assert again.state().count() == 100
    records(spark, rows[0]).write.parquet(f"{root}/data/000000000002-orphan")  # a commit that stopped before its manifest
    assert again.state().count() == 100 and again.current() == 1
    assert again.clean(hours=-1) == ["000000000002-orphan"]
    assert store.VersionedStore(spark, root, "development").clean(hours=-1) == []


def test_corrupt_manifest(spark, tmp_path):
    kept = store.VersionedStore(spark, str(tmp_path / "s"))
    kept.commit(records(spark, ("entity", "a", "1", "created")), 0)
    kept.files.replace(f"{kept.root}/manifests/{1:012d}", '{"schema": 9}')
    with pytest.raises(store.StoreError):
        kept.state()


def test_transactions(spark, tmp_path):
    kept = store.VersionedStore(spark, str(tmp_path / "s"))
    stale, synced = store.Transaction.begin(kept), []
    first = store.Transaction.begin(kept)
    first.stage("entity", "a", "1", "created")
    with pytest.raises(store.StoreError):
        first.stage("entity", "a", "2")
    assert first.commit(lambda base, version: synced.append((base, version))) == 1 and synced == [(0, 1)]
    with pytest.raises(store.StoreError):
        first.stage("entity", "b", "1")
    stale.stage("entity", "a", "9")
    with pytest.raises(store.ConflictError):
        stale.commit()
    undone = store.Transaction.begin(kept)
    undone.stage("entity", "c", "1")
    undone.rollback()
    assert kept.current() == 1 and undone.state == "rolled back"
    with pytest.raises(store.StoreError):
        store.Transaction.begin(kept).validate()


def test_journal_and_recovery(spark, tmp_path):
    journal = store.Journal(spark, str(tmp_path / "j"))
    assert journal.committed().count() == 0
    for n in (1, 2, 3):
        journal.prepare(n, {"id": f"r{n}"})
    journal.commit(1)
    journal.commit(3)
    with pytest.raises(store.ConflictError):
        journal.prepare(1, {})
    (tmp_path / "j" / "journal" / "000000000002.commit").write_text('{"num')  # torn
    assert sorted(x.number for x in journal.committed().collect()) == [1, 3]

    snapshot = spark.createDataFrame([("e", "a", "1", 1), ("e", "b", "1", 1)], "kind string, id string, content string, version bigint")
    entries = [(1, 0, 0, "e", "a", "old"), (2, 1, 0, "e", "a", "2"), (3, 2, 0, "e", "a", "3"), (3, 2, 1, "e", "c", "3")]
    schema = "version bigint, base bigint, seq bigint, kind string, id string, content string"
    got = {x.id: x.content for x in store.recover(snapshot, 1, spark.createDataFrame(entries, schema)).collect()}
    assert got == {"a": "3", "b": "1", "c": "3"}
    with pytest.raises(store.StoreError):
        store.recover(snapshot, 1, spark.createDataFrame([entries[3]], schema))


def test_documents(spark, tmp_path):
    docs = store.DocumentStore(spark, str(tmp_path / "d"))
    docs.create("a/b.json", "1")
    with pytest.raises(store.ConflictError):
        docs.create("a/b.json", "2")
    docs.replace("a/b.json", "3")
    assert docs.get("a/b.json") == "3" and docs.get("zz") is None
    assert docs.delete("a/b.json") and not docs.contains("a/b.json")
    for bad in ("/a", "a/../b", "", "a//b", "./a"):
        with pytest.raises(store.StoreError):
            docs.contains(bad)


def test_search(spark):
    texts = spark.createDataFrame([("s", "1", "red red bolt"), ("s", "2", "Red nut"), ("s", "3", "")], "source string, reference string, text string")
    posts = index.postings(texts)
    queries = spark.createDataFrame([(1, "red, RED bolt"), (2, "none")], "query_id int, text string")
    got = [(x.query_id, x.ref.split("\x1f")[1], x.score) for x in index.hits(index.search(posts, queries), 5).orderBy("query_id", "place").collect()]
    assert got == [(1, "1", 3), (1, "2", 2)]
    changed = index.upsert(posts, spark.createDataFrame([("s", "1", "blue")], "source string, reference string, text string"))
    assert {x.term for x in changed.where(F.col("ref").endswith("1")).collect()} == {"blue"}
    changes = spark.createDataFrame([("s", "1", True), ("s", "9", False)], "source string, reference string, removed boolean")
    with pytest.raises(index.IndexError_):
        index.search_sync(posts, changes, texts)


def test_index_states():
    sync, calls = index.Synchroniser(), []

    def boom():
        raise RuntimeError("disk")

    report = sync.apply(0, 1, {"forward": lambda: calls.append(1), "reverse": boom, "search": boom})
    assert report["forward"] == "synchronised" and report["reverse"].startswith("failed")
    assert not sync.states["reverse"].queryable and sync.states["search"].queryable and sync.states["search"].state == "stale"
    assert sync.apply(0, 1, {"forward": lambda: calls.append(2)}) == {"forward": "unchanged"} and calls == [1]
    assert sync.apply(5, 6, {"forward": lambda: None}) == {"forward": "conflict"}


def test_streamed_states_follow_allowed_steps_only(spark, tmp_path):
    rows = [("a", 1, "received"), ("a", 2, "mapped"), ("a", 3, "normalized"), ("b", 4, "mapped"), ("b", 5, "received")]
    frame = spark.createDataFrame(rows, "candidate string, seq bigint, state string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = ingest.read(spark, str(tmp_path / "in"), "*.parquet", frame.schema)
    got = {(x.candidate, x.seq): x.allowed for x in ingest.run_available(ingest.transitions(stream), str(tmp_path)).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 4): False, ("b", 5): True}


def test_engine(spark):
    engine = Engine(spark)
    with pytest.raises(EngineError):
        engine.handle("echo", 1)
    engine.start()
    engine.register("count", lambda n: spark.range(n).count())
    assert engine.handle("count", 3) == 3 and engine.handle("echo", "x") == "x"
    for bad in (("nope", 1, None), ("echo", 1, "other")):
        with pytest.raises(EngineError):
            engine.handle(bad[0], bad[1], bad[2])
    engine.stop()
    assert engine.state == "stopped"


def test_of_two_writers_one_fails(spark, tmp_path):
    """Whatever the order of their tests, a file is created once, whole; nothing is left beside it."""
    from concurrent.futures import ThreadPoolExecutor

    files = store.Files(spark, str(tmp_path))

    def write(i):
        try:
            files.create(f"{tmp_path}/m/one", f"text {i}\n")
            return i
        except store.ConflictError:
            return None

    (tmp_path / "m").mkdir()
    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(24)) if x is not None]
    assert len(won) == 1 and files.read(f"{tmp_path}/m/one") == f"text {won[0]}\n"
    files.replace(f"{tmp_path}/m/one", "other\n")
    assert files.read(f"{tmp_path}/m/one") == "other\n" and files.names(f"{tmp_path}/m") == ["one"]


def test_updates_must_cover_the_commit(spark):
    rows = lambda *ids: spark.createDataFrame([("entity", i) for i in ids], "target_kind string, reference string")
    done = []
    steps = {"forward": lambda: done.append(1), "search": lambda: done.append(2)}
    sync = index.Synchroniser()
    report = sync.apply(0, 1, steps, rows("a", "b"), rows("a"))
    assert all(x.startswith("failed") for x in report.values()) and not done
    assert not sync.states["forward"].queryable and sync.states["search"].state == "stale"
    assert index.Synchroniser().apply(0, 1, steps, rows("a"), rows("a")) == {"forward": "synchronised", "search": "synchronised"} and done == [1, 2]


def test_checkpoints_need_a_shared_folder(spark):
    from factloom.operators import lineage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError):
        lineage.checkpoint_folder(Session())
