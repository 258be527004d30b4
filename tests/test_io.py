from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.functions import text
from taxaflow.session import new_shared_path, shared_dir
from taxaflow.sources import files, keyed_tables, sinks, tables
from taxaflow.sources.keyed_tables import read_table


def now():
    return F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "taxon_counts", user="u", password="p", key="id", lower=0, upper=100, partitions=4)
    assert options["fetchsize"] == "1000" and options["connectTimeout"] == "10000" and options["sslMode"] == "REQUIRED"
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", "0", "100", "4")
    local = tables.jdbc_options("jdbc:x", "t", user="u", tls=False)
    assert "password" not in local and "sslMode" not in local and "partitionColumn" not in local
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", key="id")


def index_of(spark):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(1, 1, True, day, day, "t"), (1, 2, False, day, None, None)], schemas.RUN_STATUS
    )


def test_status_begin_replaces_the_document(spark):
    pairs = spark.createDataFrame([(1, 1), (9, 9), (9, 9)], "pipeline_run_id BIGINT, background_id BIGINT")
    begun = {(r.pipeline_run_id, r.background_id): r for r in sinks.run_status_begin(index_of(spark), pairs, now()).collect()}
    assert len(begun) == 3
    row = begun[1, 1]
    assert (row.is_complete, row.created_at, row.last_read_at, row.deletion_task) == (False, dt.datetime(2024, 2, 1), None, None)


def test_status_complete_changes_one_field(spark):
    pairs = spark.createDataFrame([(1, 2), (5, 5)], "pipeline_run_id BIGINT, background_id BIGINT")
    done = {r.background_id: r for r in sinks.run_status_complete(index_of(spark), pairs).collect()}
    assert done[2].is_complete and done[1].is_complete and done[1].deletion_task == "t" and len(done) == 2


def test_archive_if_absent(spark, rows):
    arn = "arn:aws:states:r:1:execution:{}:{}"
    names = [("prod-main-1", "prod-a"), ("prod-main-1", "prod-b"), ("dev-main-1", "prod-c"), ("prod-main-1", "test-d")]
    executions = spark.createDataFrame(
        [(arn.format(*n), '{"OutputPrefix": "s3://b/out/"}') for n in names], "execution_arn STRING, input STRING"
    )
    archived = spark.createDataFrame([(arn.format(*names[1]),)], "execution_arn STRING")
    a = arn.format(*names[0])
    got = sinks.archive_if_absent(executions, archived, "prod-main-1", "prod")
    assert rows(got) == [(a, f"s3://b/out/sfn-desc/{a}", f"s3://b/out/sfn-hist/{a}")]


def test_emit_metrics_appends(spark, tmp_path):
    frame = spark.createDataFrame([("n", "m", 1.0)], "namespace STRING, metric STRING, value DOUBLE")
    for _ in range(2):
        sinks.emit_metrics(frame, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


HEADER = "version,index_version,sample,timestamp,wall_seconds,NT_aupr,NR_aupr\n"


def test_load_benchmarks(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(HEADER + "v1,2021-01-22,s1,2021-07-02T11:50:01.655693,9,0.5,1.0\nv1,2021-01-22,s2,2021-07-02T11:50:01,9,0.25,1.0\n")
    got = files.load_benchmarks(spark, str(path)).orderBy("sample").collect()
    assert [(r["sample"], r.wall_seconds, r.NT_aupr) for r in got] == [("s1", 9, 0.5), ("s2", 9, 0.25)]
    assert got[0].timestamp == dt.datetime(2021, 7, 2, 11, 50, 1, 655693)


@pytest.mark.parametrize("line", ["v1,2021-01-22,s1,2021-07-02T11:50:01,9,0.5\n", "v1,2021-01-22,s1,2021-07-02T11:50:01,9,0.5,1.0,7\n"])
def test_load_benchmarks_checks_the_column_count(spark, tmp_path, line):
    path = tmp_path / "b.csv"
    path.write_text(HEADER + line)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|Malformed"):
        files.load_benchmarks(spark, str(path)).collect()


def test_files_are_appended_once(spark, tmp_path, rows):
    """Loading a file again adds nothing; a bad row in any file leaves the table as it was."""
    table, good = new_shared_path(spark, "scores"), "v1,2021-01-22,{},2021-07-02T11:50:01,9,0.5,1.0\n"
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(HEADER + good.format(name + "1") + good.format(name + "2"))
    files.append_benchmarks(spark, str(tmp_path / "a.csv"), table)
    for path in (tmp_path / "a.csv", tmp_path, tmp_path / "b.csv"):
        files.append_benchmarks(spark, str(path), table)
    want = [("a1",), ("a2",), ("b1",), ("b2",)]
    assert rows(read_table(spark, table), "sample") == want
    (tmp_path / "c.csv").write_text(HEADER + good.format("c1") + "v1,2021-01-22,c2,2021-07-02T11:50:01,9,0.5\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|Malformed"):
        files.append_benchmarks(spark, str(tmp_path), table)
    assert rows(read_table(spark, table), "sample") == want
    (tmp_path / "c.csv").write_text(HEADER + good.format("c1"))
    files.append_benchmarks(spark, str(tmp_path), table)
    assert rows(read_table(spark, table), "sample") == [*want, ("c1",)]


def test_an_append_moves_no_rows_that_the_table_holds(spark, tmp_path, rows, monkeypatch):
    """Old files stay as they are, a repeat writes nothing, and a bucket of many appends becomes one folder again."""
    table, good = new_shared_path(spark, "scores"), "v1,2021-01-22,{},2021-07-02T11:50:01,9,0.5,1.0\n"
    monkeypatch.setattr(keyed_tables, "MOST_FOLDERS", 3)
    held = []
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(HEADER + good.format(f"{i}a") + good.format(f"{i}b"))
        files.append_benchmarks(spark, str(tmp_path), table)
        version = keyed_tables.current_version(spark, table)
        assert [(version.number, b.rows) for b in version.buckets.values()] == [(i + 1, 2 * (i + 1))]
        held.append(set(version.buckets[""].folders))
        assert rows(read_table(spark, table), "sample") == [(f"{j}{x}",) for j in range(i + 1) for x in "ab"]
    assert held[0] < held[1] < held[2] and not held[2] & held[3] and held[3] < held[4]
    assert [len(h) for h in held] == [1, 2, 3, 1, 2]
    files.append_benchmarks(spark, str(tmp_path / "1.csv"), table)
    assert keyed_tables.current_version(spark, table).number == 5
    assert keyed_tables.expire_versions(spark, table, keep=1) == 4
    assert read_table(spark, table).count() == 10


def test_appended_files_split_and_beyond_the_broadcast(spark, tmp_path, rows, monkeypatch):
    table, good = new_shared_path(spark, "scores"), "v1,2021-01-22,{},2021-07-02T11:50:01,9,0.5,1.0\n"
    monkeypatch.setattr(keyed_tables, "MOST_FOLDERS", 1)

    def append(path):
        loaded = files.load_benchmarks(spark, str(path)).withColumn("loaded_from", F.col("_metadata.file_name"))
        keyed_tables.append_new_keys(spark, table, loaded, ["loaded_from"], bucket_rows=4)

    for i in range(12):
        (tmp_path / f"{i:02}.csv").write_text(HEADER + good.format(f"{i:02}") * 2)
        if i in (3, 5):
            append(tmp_path)
    monkeypatch.setattr(keyed_tables, "BROADCAST_KEYS", 2)
    for _ in range(2):
        append(tmp_path)
    buckets = keyed_tables.current_version(spark, table).buckets
    assert len(buckets) > 2 and sum(b.rows for b in buckets.values()) == 24 and sum(2.0 ** -len(bits) for bits in buckets) == 1
    assert rows(read_table(spark, table), "sample") == sorted([(f"{i:02}",) for i in range(12)] * 2)


def test_a_store_is_listed_by_tasks(spark, tmp_path, rows):
    """A partition for every outer prefix; folders below, prefixes without objects, and suffixes."""
    for name, size in (("x/1/a.fa", 4), ("x/1/b.txt", 2), ("x/2/3/c.fa", 7), ("y/d.fa", 0), ("xx/e.fa", 1)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("A" * size)
    listed = files.list_store(spark, str(tmp_path), ["x/", "x/1", "y", "absent"])
    assert listed.rdd.getNumPartitions() == 3
    assert rows(listed, "key", "size") == [("x/1/a.fa", 4), ("x/1/b.txt", 2), ("x/2/3/c.fa", 7), ("y/d.fa", 0)]
    assert rows(files.list_store(spark, f"file://{tmp_path}", [""], ".fa"), "key") == [("x/1/a.fa",), ("x/2/3/c.fa",), ("xx/e.fa",), ("y/d.fa",)]
    modified = listed.where("key = 'y/d.fa'").first()["last_modified"]
    assert abs((modified - dt.datetime.fromtimestamp((tmp_path / "y/d.fa").stat().st_mtime, dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 1


def test_ranges_of_a_skewed_key_hold_about_equal_rows(spark, rows):
    """A third of the rows in one narrow range, another third under one key."""
    keys = spark.range(30_000).selectExpr("CASE id % 3 WHEN 0 THEN id * 1000 WHEN 1 THEN 5000 + id % 200 ELSE 77 END AS k", "id")
    keys = keys.union(spark.createDataFrame([(None, -5), (-9, None)], "k BIGINT, id BIGINT"))
    bounds = tables.key_bounds(keys, "k", 12)
    assert 77 in bounds and 78 in bounds
    predicates = tables.range_predicates("k", bounds)
    counts = [keys.where(p).count() for p in predicates]
    assert sum(counts) == 30_002 and sorted(counts)[-2] <= 2 * 30_000 / 12
    dealt = tables.range_predicates("k", bounds, "id", 4)
    assert len(dealt) == len(predicates) + 3
    counts = [keys.where(p).count() for p in dealt]
    assert sum(counts) == 30_002 and max(counts) <= 1.5 * 30_000 / 12
    assert tables.range_predicates("k", tables.key_bounds(keys.limit(0), "k", 4)) == ["1 = 1"]
    assert tables.key_bounds(keys, "k", 1) == []


def test_archive_writes_what_is_absent(spark, rows):
    """A description that is archived stays; a history that is missing beside it is added."""
    executions = spark.createDataFrame(
        [(f"arn:aws:states:us-west-2:1:execution:prod-main-1:prod-{i}", '{"OutputPrefix": "s3://o/"}', "DONE") for i in range(3)]
        + [("arn:aws:states:us-west-2:1:execution:dev-main-1:prod-9", '{"OutputPrefix": "s3://o"}', "DONE")],
        "execution_arn STRING, input STRING, status STRING",
    )
    events = executions.where("execution_arn NOT LIKE '%prod-2'").selectExpr("execution_arn", "explode(sequence(2, 1, -1)) AS event_id", "'Entered' AS type")
    objects = sinks.archived_objects(executions, events, "prod-main-1", "prod")
    path, first = new_shared_path(spark, "archive"), executions.first()["execution_arn"]
    early = objects.where(F.col("execution_arn") == first).where("kind = 'description'").withColumn("body", F.lit("early"))
    for batch in (early, objects, objects):
        sinks.archive(spark, path, batch)
    held = read_table(spark, path)
    assert held.count() == 6 and held.select("execution_arn", "kind").distinct().count() == 6
    of_first = held.where(F.col("execution_arn") == first)
    assert rows(of_first, "kind", "path", "body") == [
        ("description", f"s3://o/sfn-desc/{first}", "early"),
        ("history", f"s3://o/sfn-hist/{first}", '{"events":[{"event_id":1,"type":"Entered"},{"event_id":2,"type":"Entered"}]}'),
    ]
    assert rows(held.where("execution_arn LIKE '%prod-2' AND kind = 'history'"), "body") == [('{"events":[]}',)]


def test_list_objects(spark, tmp_path, rows):
    (tmp_path / "d" / "2024-01-01").mkdir(parents=True)
    (tmp_path / "d" / "2024-01-01" / "nt.fa").write_text("ACGT")
    (tmp_path / "d" / "readme.txt").write_text("x")
    listed = files.list_folder(spark, str(tmp_path / "d"))
    assert rows(listed.select(F.substring_index("key", "/", -1).alias("k"), "size")) == [("nt.fa", 4), ("readme.txt", 1)]
    assert files.list_folder(spark, str(tmp_path / "d"), "*.fa").count() == 1


@pytest.mark.parametrize(
    ("name", "words", "acronyms"),
    [
        ("HostFilter", "HOST_FILTER", "HOST_FILTER"),
        ("NonHostAlignment", "NON_HOST_ALIGNMENT", "NON_HOST_ALIGNMENT"),
        ("DownloadNT", "DOWNLOAD_NT", "DOWNLOAD_NT"),
        ("NTIndex", "NT_INDEX", "NTINDEX"),
        ("Assemble", "ASSEMBLE", "ASSEMBLE"),
        ("Run", "RUN", "RUN"),
    ],
)
def test_stage_names(spark, name, words, acronyms):
    row = spark.createDataFrame([(name,)], "n STRING").select(
        text.snake_upper(F.col("n")), text.snake_upper_acronyms(F.col("n")), text.stage_uri_key(F.col("n"), "output")
    ).first()
    assert tuple(row) == (words, acronyms, f"{words}_OUTPUT_URI")


@pytest.mark.parametrize(
    ("uri", "bucket", "key"),
    [("s3://b/a/c.txt", "b", "a/c.txt"), ("s3://b/", "b", ""), ("https://b/a", None, None), ("s3:/b/a", None, None)],
)
def test_uris(spark, uri, bucket, key):
    frame = spark.createDataFrame([(uri,)], "u STRING")
    assert tuple(frame.select(text.uri_bucket(F.col("u")), text.uri_key(F.col("u"))).first()) == (bucket, key)


def test_gzip_magic(spark):
    frame = spark.createDataFrame([(bytearray(b"\x1f\x8bx"),), (bytearray(b"ab"),)], "c BINARY")
    assert [r[0] for r in frame.select(text.is_gzip(F.col("c"))).collect()] == [True, False]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_shared_path(spark, "x") != new_shared_path(spark, "x")
