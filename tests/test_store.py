"""The event store: what is read, what a broken or losing writer leaves."""

import pytest
from check_oracles import compare, duck
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from logfathom.model import align
from logfathom.operators import prune, query, stats
from logfathom.operators import store as store_module
from logfathom.operators.query import EventFilter
from logfathom.operators.store import EventStore, VersionTaken, ingest, insert_new
from logfathom.operators.cef import normalize_cef
from logfathom.session import gathered, remove_path
from logfathom.sources.lines import read_lines

SF = "/root/testdata/sf0.001"


def rows(spark, n=400, first=0):
    base = spark.range(first, first + n)
    return align(
        base.select(
            F.concat(F.lit("e"), "id").alias("event_id"),
            F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.concat(F.lit("10.0."), (F.col("id") % 4), F.lit("."), F.col("id") % 250).alias("source_ip"),
            F.when(F.col("id") % 2 == 0, "high").alias("severity"), (F.col("id") % 10).cast("int").alias("severity_code"),
            F.concat(F.lit("Login of Ünit "), F.col("id").cast("string")).alias("message"), F.lit("CEF").alias("source_format"),
        )
    )


def test_new_sources_are_compared_with_nothing(spark, tmp_path):
    """The stored events are taken away: an insert of new files does not miss
    them, one of a file that is known does."""
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.log").write_text("".join(f"CEF:0|a|b|1|{i}|n|3|src=1.1.1.1 msg={name}\n" for i in range(50)))
    store = EventStore(spark, str(tmp_path / "store"))
    assert ingest(read_lines(spark, str(tmp_path / "one")), normalize_cef, store, session_id="a") == 50
    remove_path(spark, f"{store.path}/events")
    assert ingest(read_lines(spark, str(tmp_path / "two")), normalize_cef, store, session_id="b") == 50
    parts = store.manifest()["parts"]
    assert [p["rows"] for p in parts] == [50, 50] and all(p["ledger"] for p in parts)
    with pytest.raises(Exception):
        ingest(read_lines(spark, str(tmp_path / "one")), normalize_cef, store, session_id="c")


def test_lines_again_add_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("".join(f"CEF:0|a|b|1|{i}|n|3|msg=x\n" for i in range(50)))
    store = EventStore(spark, str(tmp_path / "store"))
    for n in (50, 60):
        (tmp_path / "in" / "x.log").write_text("".join(f"CEF:0|a|b|1|{i}|n|3|msg=x\n" for i in range(n)))
        ingest(read_lines(spark, str(tmp_path / "in")), normalize_cef, store, session_id=f"s{n}")
        assert store.events().count() == n
    # rows that lost their place are compared with everything
    lost = store.events().withColumns({"source": F.lit(None).cast("string"), "seq": F.lit(None).cast("bigint")})
    store.insert(lost, "lost", ledger=True)
    assert store.events().count() == 60


def test_files_are_pruned_by_time_address_and_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logfathom.operators.store.ROWS_PER_FILE", 50)
    store = EventStore(spark, str(tmp_path / "store"))
    store.insert(rows(spark), "a b%")
    every = store.events()
    filters = [
        EventFilter(from_time="2023-11-20", to_time="2023-11-21"), EventFilter(source_ip="10.0.2.1"), EventFilter(search="ünit 39_"),
        EventFilter(search="t 12"), EventFilter(severity="HIGH"), EventFilter(search="nowhere"), EventFilter(search="o%f_ü"), EventFilter(search="\\"),
        EventFilter(is_malicious=True), EventFilter(geo_country="x"), EventFilter(source_format="cef", session_id="a b%"), EventFilter(session_id="b"),
    ]
    total = len(every.inputFiles())
    assert total == 8
    for where in filters:
        found = store.events(where=where)
        assert sorted(r.event_id for r in found.collect()) == sorted(r.event_id for r in where.apply(every).collect()), where
    assert len(store.events(where=filters[0]).inputFiles()) <= total // 2
    assert len(store.events(where=filters[3]).inputFiles()) < total
    for none in (5, 8, 9, 11):
        assert store.events(where=filters[none]).inputFiles() == []
    # wildcards and short needles ask for the runs between them, or for none
    assert prune.needed_runs("ab%c_d") == [] and prune.needed_runs("abcd%ef") == ["abc", "bcd"]


def test_report_reads_no_events(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert {(r.section, r.n) for r in store.report().collect()} == {("total", 0), ("malicious", 0)}
    for name, part in (("a", rows(spark, 100)), ("b", rows(spark, 150)), ("c", rows(spark, 20, 1000))):
        store.insert(part, name)
    store.delete("c")
    want = sorted(map(str, stats.report(store.events()).collect()))
    remove_path(spark, f"{store.path}/events")
    assert sorted(map(str, store.report().collect())) == want


def test_a_broken_insert_leaves_nothing(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"))
    store.insert(rows(spark, 10), "a")

    def broken(base, manifest):
        raise OSError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", broken)
        with pytest.raises(OSError):
            store.insert(rows(spark, 30), "b")
        with pytest.raises(OSError):
            store.delete("a")
    assert store.version() == 1 and store.events().count() == 10 and store.report().filter("section = 'total'").first().n == 10
    store.insert(rows(spark, 30), "b")
    assert store.events().count() == 30 and store.events(version=1).count() == 10
    store.vacuum()
    assert store.events().count() == 30


def test_the_second_of_two_writers_compares_again(spark, tmp_path):
    one, two = (EventStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.insert(rows(spark, 10), "a")
    inner, first = two._write_part, []

    def late(*args):
        part = inner(*args)
        if not first:  # the other one commits before this writer does
            first.append(one.insert(rows(spark, 40), "b"))
        return part

    two._write_part = late
    assert two.insert(rows(spark, 60), "c") == 60
    assert two.events().count() == two.events().select("event_id").distinct().count() == 60
    assert {p["session"]: p["rows"] for p in two.manifest()["parts"]} == {"a": 10, "b": 30, "c": 20}
    with pytest.raises(VersionTaken):
        one._commit(0, one.manifest())


def test_compacted_sessions(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.insert(rows(spark, 10, 10 * i), "s", more=True)
    store.insert(rows(spark, 5, 100), "t")
    store.compact("s")
    assert [(p["session"], p["rows"]) for p in store.manifest()["parts"]] == [("t", 5), ("s", 30)]
    store.vacuum()
    assert store.events().count() == 35 and store.insert(rows(spark, 40), "u") == 40 and store.events().count() == 45
    assert {r.session_id: r.event_count for r in store.sessions().collect()} == {"s": 30, "t": 5, "u": 40}


@pytest.mark.parametrize("order_by", ["timestamp ASC", "severity DESC", "severity ASC", "abuse_score DESC"])
def test_pages_after_a_key(spark, order_by):
    events = rows(spark, 60).withColumn("timestamp", F.when(F.col("severity_code") > 2, F.col("timestamp")))
    column, last, got = query.parse_order(order_by)[0], None, []
    for _ in range(7):
        page = query.page_after(events, last, 10, order_by).select(column, "event_id").collect()
        got += [r.event_id for r in page]
        last = tuple(page[-1]) if page else last
    assert got == [r.event_id for r in query.page(events, 100, 0, order_by).collect()]


NAMES = ["store_report", "store_search", "delete_all", "page_after", "store_writers", "reingest_ledger"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, text = compare(queries()[name](spark, SF), duck(SF), oracle_sql()[name])
    assert ok, text


def test_whole_rows_are_not_sorted_in_one_task(spark, tmp_path, monkeypatch):
    """Long texts make more files; only repeated ids are combined; null ids are one."""
    monkeypatch.setattr(prune, "FILE_BYTES", 2_000)
    store = EventStore(spark, str(tmp_path / "store"))
    batch = rows(spark, 400).unionByName(rows(spark, 30, 390)).withColumn("at", F.monotonically_increasing_id())
    assert store.insert(batch, "a", order=["at"]) == 430
    assert store.events().count() == 420 == store.events().select("event_id").distinct().count()
    assert len(store.events().inputFiles()) > 5
    once = insert_new(rows(spark, 50), rows(spark, 10).select("event_id"), ["message"])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and once.count() == 40
    nulls = rows(spark, 9).withColumn("event_id", F.when(F.col("severity_code") < 5, F.col("event_id")))
    for order in (["message"], None):
        kept = insert_new(nulls, rows(spark, 2).select("event_id"), order)
        assert sorted(r.event_id or "" for r in kept.collect()) == ["", "e2", "e3", "e4"]


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {(r.seq, r.value) for r in read_lines(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 50
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {(r.seq, r.value) for r in lines.collect()} == want
        # a join is set up once per task, not once per split
        spark.range(3).write.parquet(str(tmp_path / "ids"))
        few = gathered(spark.read.parquet(str(tmp_path / "ids"))).join(F.broadcast(spark.range(2)), "id", "left_semi")
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") < plan.index("Repartition") and few.count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_known_lines_write_nothing_and_new_files_are_not_compared(spark, tmp_path, monkeypatch):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.log").write_text("".join(f"CEF:0|a|b|1|{i}|n|3|src=1.1.1.1 msg={name}\n" for i in range(50)))
    one, two, store = str(tmp_path / "one"), str(tmp_path / "two"), EventStore(spark, str(tmp_path / "store"))
    compared = []
    real = store_module.new_rows
    monkeypatch.setattr(store_module, "new_rows", lambda fresh, batch, stored: compared.append(batch.count()) or real(fresh, batch, stored))
    for name, paths in (("a", [one]), ("b", [one, two]), ("c", [two, one]), ("c", [one])):
        ingest(read_lines(spark, paths), normalize_cef, store, session_id=name)
    assert compared == [50, 100, 50]
    parts = store.manifest()["parts"]
    assert [p["rows"] for p in parts] == [50, 50, 0, 0]
    assert not (tmp_path / "store/events/session_id=c").exists()
    store.compact("c")
    assert len(store.manifest()["parts"]) == 3 and store.events().count() == 100
    assert store.events().select("event_id").distinct().count() == 100


@pytest.mark.parametrize("bound", [0, 5, 1000])
def test_few_new_ids_are_sent_instead_of_many_known(spark, monkeypatch, bound):
    """Whichever of the ids is sent to the batch, the same rows are new."""
    monkeypatch.setattr(store_module, "BROADCAST_ROWS", bound)
    batch = rows(spark, 12).unionByName(rows(spark, 2, 10)).withColumn("event_id", F.when(F.col("severity_code") != 4, F.col("event_id")))
    kept = insert_new(batch, rows(spark, 9).select("event_id"), ["message"])
    assert sorted(r.event_id or "" for r in kept.collect()) == ["", "e10", "e11", "e9"]
    assert insert_new(rows(spark, 5), rows(spark, 9).select("event_id")).count() == 0


def test_all_cores_write(spark, monkeypatch):
    monkeypatch.setattr(prune, "ROWS_PER_TASK", 50)
    assert prune.clustered(rows(spark, 200), rows(spark, 200), 1_000_000).rdd.getNumPartitions() == 4
