"""Hostile input, skewed and large joins against brute force, plans, the store."""

import time

from pyspark.sql import functions as F

from logfathom.functions import net
from logfathom.functions.severity import facility, level
from logfathom.functions.text import BEFORE_KEY, JOINT, key_values, marked_map, spaced_marks, split_before_keys
from logfathom.model import align
from logfathom.operators import enrich, lookup, registry
from logfathom.operators.cef import normalize_cef
from logfathom.operators.query import parse_order
from logfathom.operators.route import normalize_files
from logfathom.operators.store import EventStore
from logfathom.operators.web import normalize_web
from logfathom.operators.windows import normalize_windows_xml
from logfathom.operators.zeek import normalize_zeek
from logfathom.sources import zeek as zeek_source


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, value string")


def test_order_falls_back():
    for bad in ("timestamp; DROP TABLE x", "1=1", "timestamp ASC, x", "password DESC", "", "timestamp up"):
        assert parse_order(bad) == ("timestamp", "DESC")
    assert parse_order("Severity asc") == ("severity", "ASC")
    assert parse_order("abuse_score") == ("abuse_score", "DESC")


def test_long_space_run_is_fast(spark):
    start = time.time()
    rows = normalize_cef(frame(spark, "CEF:0|a|b|1|2|n|5|src=1.2.3.4" + " " * 50000 + "!")).collect()
    assert rows[0].source_ip.startswith("1.2.3.4") and time.time() - start < 20


def test_joint_in_text(spark):
    text = f'1.2.3.4 - - [x] "GET /{JOINT} HTTP/1.1" 200 5'
    row = normalize_web(frame(spark, text)).first()
    assert row.event_action == "GET 200" and row.extensions["http_path"] == f"/{JOINT}"


def test_map_ways_agree(spark):
    texts = ["a=1 b=2", "x a=1", "a= 1 b =2", "a=1  b==2 c", "", "a", "a=\tb=2", "k=v\x1cz=1", f"a={JOINT} b=1", "é=1 ü=2"]
    v = F.col("value")
    rows = frame(spark, *texts).select(
        key_values(split_before_keys(v)).alias("slow"), marked_map(spaced_marks(v)).alias("quick")
    ).collect()
    assert all(r.quick is None or r.quick == r.slow for r in rows)
    assert rows[0].quick == {"a": "1", "b": "2"} and rows[1].slow == {"a": "1"}
    assert BEFORE_KEY


def test_priorities(spark):
    rows = spark.createDataFrame([(14,), (999,), (-1,)], "p bigint").select(
        facility(F.col("p")).alias("f"), level(F.col("p")).alias("l")
    ).collect()
    assert [tuple(r) for r in rows] == [("user", "info"), ("unknown", "unknown"), ("unknown", "unknown")]


def test_hostile_xml(spark):
    entity = '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><Events><Event><System><Computer>&e;</Computer></System></Event></Events>'
    rows = normalize_windows_xml(frame(spark, entity)).collect()
    assert all("root:" not in (r.message or "") and r.source_host is None for r in rows)


def test_private_addresses(spark):
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in
            ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7")]
    texts = ["172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "1:2:3:4:5:6:7::", "::", "::1", "1::",
             "fdab::1", "fe00::", "1:2:3:4:5:6:7:8:9", ":::", "12345::", "::ffff:1.2.3.4", "0::1", "::10", "1.2.3"]

    def want(t):
        try:
            return any(ipaddress.ip_address(t) in n for n in nets)
        except ValueError:
            return True

    got = {r.value: r.p for r in frame(spark, *texts).select("value", net.is_private(F.col("value")).alias("p")).collect()}
    assert got == {t: want(t) for t in texts}


def events_for(spark, ips):
    rows = spark.createDataFrame([(str(i), ip) for i, ip in enumerate(ips)], "event_id string, source_ip string")
    return align(rows)


def test_geo_both_ways_match_brute_force(spark, monkeypatch):
    base = 20 << 24
    ranges = [(base, base + (1 << 24) - 1, "wide"), (base + 100, base + 70000, "mid"), (base + 65000, base + 66000, "narrow"),
              (base + (3 << 16), base + (5 << 16) + 9, "blocks")]
    numbers = [base + d for d in (0, 99, 100, 64999, 65000, 66000, 66001, 70000, 70001, 3 << 16, (5 << 16) + 9, (5 << 16) + 10)]
    ips = [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers] * 3 + ["20.0.0.0"] * 200
    geo = spark.createDataFrame(
        [(lo, hi, c, c, c, 1.0, 2.0, c, c) for lo, hi, c in ranges],
        "ip_lo bigint, ip_hi bigint, country string, country_code string, city string, lat double, lon double, isp string, asn string",
    )

    def best(ip):
        n = sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0)))
        return min((hi - lo, c) for lo, hi, c in ranges if lo <= n <= hi)[1]

    want = sorted((str(i), best(ip)) for i, ip in enumerate(ips))
    events = events_for(spark, ips)
    small = enrich.enrich_geo(events, geo).select("event_id", "geo_country")
    assert sorted(map(tuple, small.collect())) == want
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    large = enrich.enrich_geo(events, geo).select("event_id", "geo_country")
    assert sorted(map(tuple, large.collect())) == want


def test_lookup_large_table_with_hot_key(spark):
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE 'k' || (id % 7) END AS k")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    both = [
        sorted(map(str, lookup.lookup_join(rows, table, {"k": "key"}, salt_by=["id"], small=s).collect())) for s in (True, False)
    ]
    assert both[0] == both[1] and len(both[0]) == 2000


def test_zeek_header_ways_agree(spark, monkeypatch):
    lines = []
    for i in range(300):
        text = "#fields\tid.orig_h\tuid" if i % 50 == 0 else "#fields\tuid\tid.orig_h" if i % 50 == 25 else f"a{i}\tb{i}"
        lines.append(("f", i // 40, i % 40, text))
    df = spark.createDataFrame(lines, "source string, block bigint, seq bigint, value string")
    want = {f"{'a' if i % 50 < 25 else 'b'}{i}" for i in range(300) if i % 25}
    quick = {r.source_ip for r in normalize_zeek(df).collect()}
    monkeypatch.setattr(zeek_source, "MAX_STATES", 0)
    windowed = {r.source_ip for r in normalize_zeek(df).collect()}
    assert quick == windowed == want


def test_no_python_and_pruned_plan(spark):
    plan = normalize_cef(frame(spark, "x")).filter("severity = 'high'").select("source_ip")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in text and "unix_micros" not in text


def test_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    rows = events_for(spark, ["1.1.1.1", "2.2.2.2", "3.3.3.3"])
    assert store.insert(rows, "007", filename="f") == 3
    assert store.insert(rows, "again") == 3 and store.events().count() == 3
    assert store.insert(rows, "007", filename="g") == 3
    assert {(r.session_id, r.filename, r.event_count) for r in store.sessions().collect()} == {("007", "g", 3), ("again", "", 3)}
    assert store.delete("007") == 3 and store.events().count() == 0
    assert [r.session_id for r in store.sessions().collect()] == ["again"]
    store.delete()
    assert store.sessions().count() == 0


def test_added_format(spark):
    def shout(df, line_col="value", key=None, keep=()):
        from logfathom.model import emit

        line = F.col(line_col)
        return emit(df, {"source_format": F.lit("shout"), "message": F.lower(line), "raw": line}, key, keep)

    registry.register_parser("shout", shout, detect_rule=lambda c: c.startswith("!!"))
    try:
        found = frame(spark, "!!X", "y").select(registry.format_of(F.col("value")).alias("f")).collect()
        assert [r.f for r in found] == ["shout", "syslog"]
        assert registry.parser_of("shout").normalize(frame(spark, "AB")).first().message == "ab"
    finally:
        registry.unregister_parser("shout")


def test_mixed_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("CEF:0|a|b|1|2|n|7|src=1.2.3.4\n\nbroken\n")
    (tmp_path / "b.json").write_text('[{"msg":"one"},\n {"msg":"two"}]')
    (tmp_path / "c.xml").write_text("<Events>\n<Event ><System><EventID>4624</EventID></System></Event>\n</Events>\n")
    rows = normalize_files(spark, str(tmp_path)).collect()
    assert sorted((r.source_format, r.message) for r in rows) == [
        ("cef", "broken"), ("cef", "n from 1.2.3.4"), ("evtx", "Windows Event 4624: logon_success"),
        ("json", "one"), ("json", "two"),
    ]
    assert len({r.event_id for r in rows}) == 5


def test_file_names_with_signs(spark, tmp_path):
    (tmp_path / "my file.json").write_text('{"msg":"one"}\n{"msg":"two"}\n')
    (tmp_path / "a [1] %20.xml").write_text("<Events><Event ><System><EventID>4624</EventID></System></Event></Events>")
    (tmp_path / "x{y}.log").write_text("#fields\tid.orig_h\tuid\n1.2.3.4\tq\n")
    rows = normalize_files(spark, str(tmp_path)).collect()
    assert sorted(r.source_format for r in rows) == ["evtx", "json", "json", "zeek"]


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.log").write_text("".join(f"CEF:0|a|b|1|{i % 7}|n|7|src=1.2.3.4\n" for i in range(5000)))
    (tmp_path / "b" / "y.log").write_text("CEF:0|a|b|1|2|n|7|src=1.2.3.4\n" * 3000)

    def ids(*paths):
        return {r.event_id for r in normalize_files(spark, [str(tmp_path / p) for p in paths]).select("event_id").collect()}

    alone, both = ids("a"), ids("a", "b")
    assert len(alone) == 5000 and len(both) == 8000 and alone < both
    sizes = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(sizes)
    spark.conf.set(sizes, "10000")
    try:
        assert ids("a", "b") == both
    finally:
        spark.conf.set(sizes, before)


def test_numbering_shuffles_no_text(spark, tmp_path):
    from logfathom.sources.lines import read_lines

    (tmp_path / "x.log").write_text("a\nb\n")
    plan = read_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_sessions_with_signs_are_deleted(spark, tmp_path):
    import os

    store = EventStore(spark, str(tmp_path / "store"))
    for name in ("a b", "2024:01", "x/y", "p%q"):
        store.insert(events_for(spark, [f"1.1.1.{len(name)}"]).withColumn("event_id", F.lit(name)), name)
        assert store.delete(name) == 1 and store.events().count() == 0 and store.sessions().count() == 0
    root = spark.conf.get("spark.checkpoint.dir")
    assert not [d for d in os.listdir(f"{root}/logfathom") if d.startswith("batch-")]


def test_scratch_folder_is_asked_for(monkeypatch):
    import pytest

    from logfathom.session import scratch_dir

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")
