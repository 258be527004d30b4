"""Keyed tables: upserts, versions, writes that break off, and buckets that grow."""

from __future__ import annotations

import pytest

from taxaflow.session import new_shared_path
from taxaflow.sources import keyed_tables
from taxaflow.sources.keyed_tables import read_table, upsert_table


def keyed(spark, *rows_):
    return spark.createDataFrame(list(rows_), "run BIGINT, tax BIGINT, v STRING")


def many(spark, runs, value="a", taxa=4):
    return spark.range(runs * taxa).selectExpr(f"id div {taxa} AS run", f"id % {taxa} AS tax", f"'{value}' AS v")


def upsert(spark, path, new, bucket_rows=20):
    upsert_table(spark, path, new, ["run", "tax"], ["run"], bucket_rows)


def files_of(spark, path):
    """Size of every data file of the current version."""
    folder, files = keyed_tables.file_system(spark, path)
    sizes = {}
    for bucket in keyed_tables.current_version(spark, path).buckets.values():
        for status in files.listStatus(folder(f"{path}/{bucket.folder}")) if bucket.folder else []:
            sizes[str(status.getPath())] = status.getLen()
    return sizes


def test_upsert_replaces_by_key_and_keeps_the_rest(spark, rows):
    old = keyed(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"))
    new = keyed(spark, (1, 2, "B"), (3, 1, "D"))
    got = keyed_tables.upsert_documents(old, new, ["run", "tax"])
    assert rows(got) == [(1, 1, "a"), (1, 2, "B"), (2, 1, "c"), (3, 1, "D")]


def test_upsert_can_be_repeated(spark, rows):
    path = new_shared_path(spark, "test-table")
    second = keyed(spark, *[(r, 0, "b") for r in range(0, 40, 3)])
    for batch in (many(spark, 20, taxa=5), second, second):
        upsert(spark, path, batch)
    want = {(r, t): "a" for r in range(20) for t in range(5)} | {(r, 0): "b" for r in range(0, 40, 3)}
    assert rows(read_table(spark, path)) == sorted((*k, v) for k, v in want.items())
    buckets = keyed_tables.current_version(spark, path).buckets
    assert sum(b.rows for b in buckets.values()) == len(want)
    assert sum(2.0 ** -len(bits) for bits in buckets) == 1  # the prefixes cover every hash once


def test_a_frame_read_before_a_write_keeps_its_rows(spark, rows):
    path = new_shared_path(spark, "test-table")
    upsert(spark, path, many(spark, 10))
    before = read_table(spark, path)
    upsert(spark, path, many(spark, 10, "b"))
    assert rows(before.select("v").distinct()) == [("a",)]
    assert rows(read_table(spark, path).select("v").distinct()) == [("b",)]


def test_a_write_that_breaks_off_changes_nothing(spark, rows, monkeypatch):
    """Stopped before its version file, or while writing it: readers have the old rows, a repeat gives the new ones."""
    path = new_shared_path(spark, "test-table")
    upsert(spark, path, many(spark, 10))
    with monkeypatch.context() as broken:
        broken.setattr(keyed_tables, "publish", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            upsert(spark, path, many(spark, 12, "b"))
    assert rows(read_table(spark, path).select("v").distinct()) == [("a",)]
    folder, files = keyed_tables.file_system(spark, path)
    out = files.create(folder(f"{path}/{keyed_tables.VERSIONS}/{2:012d}.json"), False)
    out.write(bytearray(b'{"schema": {"ty'))
    out.close()
    assert rows(read_table(spark, path).select("v").distinct()) == [("a",)]
    upsert(spark, path, many(spark, 12, "b"))
    assert read_table(spark, path).count() == 48 and rows(read_table(spark, path).select("v").distinct()) == [("b",)]
    assert keyed_tables.current_version(spark, path).number == 3


def test_of_two_writers_one_fails_and_can_repeat(spark, rows):
    path = new_shared_path(spark, "test-table")
    upsert(spark, path, many(spark, 10))
    inner = []

    def change(old):
        if not inner:  # another job writes in between
            inner.append(upsert(spark, path, keyed(spark, (3, 0, "other"))))
        return keyed_tables.upsert_documents(old, new, ["run", "tax"])

    new = keyed(spark, (3, 1, "mine"))
    with pytest.raises(keyed_tables.CommitConflict):
        keyed_tables.rewrite(spark, path, new, ["run"], change, adds=True)
    upsert(spark, path, new)
    assert rows(read_table(spark, path).where("run = 3")) == [(3, 0, "other"), (3, 1, "mine"), (3, 2, "a"), (3, 3, "a")]
    with pytest.raises(keyed_tables.CommitConflict):
        keyed_tables.publish(spark, path, keyed_tables.current_version(spark, path))


def test_a_run_rewrites_as_little_in_a_table_ten_times_larger(spark):
    """Files written for one run, by the lists before and after, with buckets of 400 rows."""
    moved, buckets = [], []
    for runs in (400, 4000):
        path = new_shared_path(spark, "test-table")
        upsert(spark, path, many(spark, runs), bucket_rows=400)
        before = files_of(spark, path)
        upsert(spark, path, keyed(spark, *[(7, t, "b") for t in range(5)]), bucket_rows=400)
        after = files_of(spark, path)
        moved.append((sum(s for f, s in after.items() if f not in before), sum(after.values())))
        buckets.append(max(b.rows for b in keyed_tables.current_version(spark, path).buckets.values()))
        assert len(after.keys() - before.keys()) <= 2
        assert read_table(spark, path).count() == runs * 4 + 1
    assert moved[1][1] > 5 * moved[0][1]
    assert moved[1][0] < 2 * moved[0][0]
    assert max(buckets) < 2 * 400


def test_full_buckets_split_as_the_table_grows(spark):
    path = new_shared_path(spark, "test-table")
    sizes = []
    for step in range(4):
        grown = spark.range(step * 60, step * 60 + 60).selectExpr("id AS run", "0L AS tax", "'a' AS v")
        upsert(spark, path, grown, bucket_rows=50)
        sizes.append(len(keyed_tables.current_version(spark, path).buckets))
    assert sizes == sorted(sizes) and sizes[-1] >= 4
    assert read_table(spark, path).select("run").distinct().count() == 240


def test_one_run_larger_than_a_bucket_stays_whole(spark, rows):
    path = new_shared_path(spark, "test-table")
    for value in ("a", "b"):
        upsert(spark, path, many(spark, 1, value, taxa=100), bucket_rows=10)
    assert rows(read_table(spark, path).groupBy("v").count()) == [("b", 100)]


def test_deleted_rows_and_empty_tables(spark, rows):
    path = new_shared_path(spark, "test-table")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    gone = keyed(spark, (1, None, None), (2, None, None))
    with pytest.raises(FileNotFoundError):
        keyed_tables.delete_rows(spark, path, gone, lambda r: r, ["run"])
    upsert(spark, path, keyed(spark).limit(0))
    assert rows(read_table(spark, path)) == []
    upsert(spark, path, many(spark, 3, taxa=1))
    for _ in range(2):
        keyed_tables.delete_rows(spark, path, gone, lambda r: r.join(gone, "run", "left_anti"), ["run"])
    assert rows(read_table(spark, path)) == [(0, 0, "a")]
    keyed_tables.delete_rows(spark, path, keyed(spark, (0, 0, "")), lambda r: r.where("false"), ["run"])
    assert rows(read_table(spark, path)) == [] and read_table(spark, path).columns == ["run", "tax", "v"]


def test_expired_versions_take_their_files_along(spark, rows):
    path = new_shared_path(spark, "test-table")
    for value in "abcd":
        upsert(spark, path, many(spark, 10, value))
    folder, files = keyed_tables.file_system(spark, path)
    kept = [b.folder for n in (3, 4) for b in keyed_tables.read_version(spark, path, n).buckets.values() if b.folder]
    gone = [b.folder for n in (1, 2) for b in keyed_tables.read_version(spark, path, n).buckets.values() if b.folder]
    assert keyed_tables.expire_versions(spark, path, keep=2) == 2
    assert keyed_tables.version_numbers(spark, path) == [3, 4]
    assert all(files.exists(folder(f"{path}/{f}")) for f in kept)
    assert not any(files.exists(folder(f"{path}/{f}")) for f in gone if f not in kept)
    assert rows(read_table(spark, path).select("v").distinct()) == [("d",)]


def test_an_upsert_stages_its_rows_compressed(spark):
    """New rows are kept beside the table in less space than their values take."""
    from taxaflow.session import shared_dir

    def held():
        folder, files = keyed_tables.file_system(spark, shared_dir(spark))
        return files.getContentSummary(folder(shared_dir(spark))).getLength()

    path, before = new_shared_path(spark, "test-table"), held()
    upsert(spark, path, many(spark, 2000, "long text " * 20, taxa=10), bucket_rows=20_000)
    assert held() - before < 20_000 * 200 / 4


def test_small_buckets_share_folders(spark, rows, monkeypatch):
    """Hundreds of small buckets of a write lie in a few files; replaced ones are read no more."""
    path = new_shared_path(spark, "test-table")
    upsert(spark, path, many(spark, 2000), bucket_rows=20)
    assert len(keyed_tables.current_version(spark, path).buckets) >= 256 and len(files_of(spark, path)) <= 64
    upsert(spark, path, many(spark, 700, "b"), bucket_rows=20)
    upsert(spark, path, keyed(spark, (1999, 0, "c")), bucket_rows=20)
    assert len(files_of(spark, path)) <= 128
    assert rows(read_table(spark, path).groupBy("v").count()) == [("a", 5199), ("b", 2800), ("c", 1)]
    monkeypatch.setattr(keyed_tables, "GROUP_ROWS", 20)
    upsert(spark, path, many(spark, 2000, "d"), bucket_rows=20)
    folders = {b.folder for b in keyed_tables.current_version(spark, path).buckets.values()}
    assert len(folders) >= 256 and rows(read_table(spark, path).groupBy("v").count()) == [("d", 8000)]


@pytest.mark.parametrize("few", [0, 1, 3, 100])
def test_an_upsert_finds_by_keys_what_stays(spark, rows, monkeypatch, few):
    """The rows of ``upsert_documents``, whichever of its ways is taken; null keys are nobody's and stay."""
    monkeypatch.setattr(keyed_tables, "BROADCAST_KEYS", few)
    old = keyed(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d"), (None, 1, "e"), (2, None, "f"))
    for new in ([(1, 2, "B"), (3, 1, "D")], [(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (None, 1, "N")], [(9, 9, "z")]):
        new = keyed(spark, *new)
        assert rows(keyed_tables.upsert_staged(old, new, ["run", "tax"])) == rows(keyed_tables.upsert_documents(old, new, ["run", "tax"]))


def test_a_repeated_upsert_moves_keys_only(spark, monkeypatch):
    """A repeat leaves no old row, so old rows are not read whole; folders of staged rows go."""
    monkeypatch.setattr(keyed_tables, "BROADCAST_KEYS", 10)
    monkeypatch.setattr(keyed_tables, "UNDEALT_ROWS", 100)
    folder, files = keyed_tables.file_system(spark, new_shared_path(spark, "x"))
    root = folder(new_shared_path(spark, "x")).getParent()

    def staged():
        return {f.getPath().getName() for f in files.listStatus(root) if f.getPath().getName().startswith("staged-")} if files.exists(root) else set()

    path, before, plans = new_shared_path(spark, "test-table"), staged(), []
    plain = keyed_tables.write_buckets

    def write_buckets(spark, path, rows, *rest, **options):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return plain(spark, path, rows, *rest, **options)

    monkeypatch.setattr(keyed_tables, "write_buckets", write_buckets)
    for value in "ab":
        upsert(spark, path, many(spark, 200, value), bucket_rows=10_000)
    assert len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
    assert read_table(spark, path).groupBy("v").count().collect() == [("b", 800)]
    assert staged() == before


def test_large_folders_are_written_without_a_move(spark, rows, monkeypatch):
    """Rows go to their few large folders from where they are; the table is the same."""
    from taxaflow.session import DROP_SHUFFLES

    monkeypatch.setattr(keyed_tables, "UNDEALT_ROWS", 100)
    monkeypatch.setattr(keyed_tables, "GROUP_ROWS", 1)
    before, path, new = spark.conf.get(DROP_SHUFFLES, None), new_shared_path(spark, "test-table"), many(spark, 400).repartition(3, "tax")
    upsert(spark, path, new, bucket_rows=400)
    assert len(files_of(spark, path)) > 4 and len(keyed_tables.current_version(spark, path).buckets) == 4
    upsert(spark, path, keyed(spark, (7, 0, "b")), bucket_rows=400)
    assert rows(read_table(spark, path).groupBy("v").count()) == [("a", 1599), ("b", 1)]
    assert spark.conf.get(DROP_SHUFFLES, None) == before
