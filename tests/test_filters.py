"""Filters, facets, fields and container selections."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import fields, predicates
from logweave.operators import facets, profile
from logweave.sources import containers

COLUMNS = "timestamp timestamp_ntz, level string, thread string, logger string, ip string, message string, source string, view string"
ROWS = [
    (None, "A", "p.t1(x)", "q.L1", "", "one Two", "s1", "v"),
    (None, "B", "p.t2", "q.L1", "unknown", "two", "s1", "v"),
    (None, "C", "t1", "Tag.java:105", " ", "x.y", None, "w"),
    (None, None, None, None, None, "", "s2", "w"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def messages(df):
    return sorted(r.message for r in df.collect())


def test_selections(df):
    keep = predicates.filter_entries
    assert messages(keep(df, {"level": ["A"]})) == ["one Two"]
    assert messages(keep(df, {"level": []})) == messages(df)
    assert messages(keep(df, {"level": ["A", "B", "C"]}, domains={"level": ["A", "B", "C"]})) == messages(df)
    assert messages(keep(df, {"thread": ["t1"], "logger": ["L1"]})) == ["one Two"]
    assert messages(keep(df, message="^T")) == []
    assert messages(keep(df, message="^T", ignore_case=True)) == ["two"]
    assert messages(keep(df, message="([")) == messages(df)
    with pytest.raises(ValueError):
        keep(df, {"message": ["x"]})


def test_large_selection(spark, df):
    chosen = spark.createDataFrame([("A",), ("A",), ("Z",)], "c string")
    assert messages(predicates.semi_selection(df, F.col("level"), chosen)) == ["one Two"]


def test_text_search(df):
    find = lambda *a, **k: messages(df.filter(predicates.text_match(*a, **k)))
    assert find("TWO") == ["one Two", "two"]
    assert find("x.y") == ["x.y"] and find("x+y") == []
    assert find("tw", whole_word=True) == []
    assert find("tag:105", ["logger", "message"]) == ["x.y"]


def test_facets(df):
    got = {(r.facet, r.value, r.n) for r in facets.facet_options(df, {"level": ["A"]}, message="TWO").collect()}
    assert got == {("level", "A", 1), ("level", "B", 1), ("thread", "t1", 1), ("logger", "L1", 1), ("source", "s1", 1)}
    options = facets.option_list(facets.all_options(df, {"level": ["A"]}, message="TWO"))
    flags = {(r.facet, r.value): r.available for r in options.collect()}
    assert flags["level", "C"] is False and flags["level", "B"] is True and flags["source", "s2"] is False
    assert len(facets.option_list(facets.all_options(df), show_unavailable=False).collect()) == len(
        facets.all_options(df).collect()
    )


def test_profiles(df):
    got = {r.view: (r.timestamp, r.level, r.ip, r.source) for r in profile.column_presence(df).collect()}
    assert got == {"v": (False, True, False, False), "w": (False, True, False, False)}
    merged = df.withColumn("view", F.lit("m"))
    assert profile.column_presence(merged).first().source is True
    assert df.agg(profile.source_count().alias("n")).first().n == 3
    shown = fields.visible_columns(merged, profile.presence_of(merged, "m"), {"thread": False})
    assert shown.columns == ["level", "logger", "message", "source"]


def test_scalar_fields(spark):
    one = spark.range(1)
    pod = lambda x: one.select(fields.workload_name(F.lit(x))).first()[0]
    assert pod("audit-7fcd847b65-rkdlp") == "audit"
    assert pod("viewer-0") == "viewer" and pod("plain") == "plain"
    assert one.select(fields.safe_file_name(F.lit("a b/ü.log"))).first()[0] == "a_b__.log"
    got = one.select(fields.short_logger(F.lit(None).cast("string")), fields.clock_text(F.lit(None).cast("timestamp_ntz"))).first()
    assert tuple(got) == ("", "")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # a wall clock that this zone skips
        ts = F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")
        assert one.select(fields.clock_text(ts)).first()[0] == "02:30:00.000"
        assert str(one.select(fields.from_epoch_millis(F.lit(1700000000123))).first()[0]) == "2023-11-14 22:13:20.123000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


LISTING = """apps|viewer-0|postgres,istio-proxy
apps\tinsight-74c9d97fb4-prj9x\tapp istio-proxy
apps   imaging-7db7d4b67b-sgtbm   app, istio-proxy
kube-system | coredns-5dd5bcc9f7-xsc7n | coredns

lonely
apps|bare-1
apps|bare-2|"""


@pytest.fixture(scope="module")
def pods(spark):
    rows = [(i, x) for i, x in enumerate(LISTING.split("\n"))]
    return containers.parse_listing(spark.createDataFrame(rows, "line_no long, line string")).drop("line_no")


def test_listing(pods):
    got = {(r.namespace, r.pod): r.containers for r in pods.collect()}
    assert got == {
        ("apps", "viewer-0"): ["postgres", "istio-proxy"],
        ("apps", "insight-74c9d97fb4-prj9x"): ["app", "istio-proxy"],
        ("apps", "imaging-7db7d4b67b-sgtbm"): ["app", "istio-proxy"],
        ("kube-system", "coredns-5dd5bcc9f7-xsc7n"): ["coredns"],
        ("apps", "bare-1"): [],
        ("apps", "bare-2"): [],
    }
    totals = {r.namespace: (r.pods, r.containers) for r in containers.namespace_totals(pods).collect()}
    assert totals == {"apps": (5, 6), "kube-system": (1, 1)}


def test_container_search(pods):
    flat = containers.flat_containers(pods)
    count = lambda **k: containers.filter_containers(flat, **k).count()
    assert (count(search="kube"), count(search="insight"), count(search=" COREDNS "), count(search="none")) == (1, 2, 1, 0)
    assert count(search="") == 9
    assert count(selections={"pod": ["insight"], "container": ["app"]}) == 1
    got = {(r.facet, r.value) for r in containers.container_options(flat, {"container": ["coredns"]}).collect()}
    assert ("namespace", "kube-system") in got and ("namespace", "apps") not in got and ("container", "app") in got


def test_path_patterns(pods):
    flat = containers.flat_containers(pods)
    pick = lambda p: {r.path.split("/", 1)[1]: r.pattern for r in containers.select_paths(flat, p).collect()}
    assert pick("apps/view*/postgres") == {"viewer-0/postgres": 0}
    assert pick("*/app") == {"insight-74c9d97fb4-prj9x/app": 0, "imaging-7db7d4b67b-sgtbm/app": 0}
    assert pick("coredns, kube-system/*") == {"coredns-5dd5bcc9f7-xsc7n/coredns": 0}
    assert pick("view*") == {}
    assert pick("apps/viewer-?/istio.proxy") == {}
