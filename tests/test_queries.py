"""Every registered query that has SQL, against another engine; scalar functions against known values."""

from numbers import Real

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallywheel.functions import identity, money, timeutil
from tallywheel.operators import sequences
from tallywheel.plans import journals, queries, registry  # noqa: F401  (journals registers its queries)

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    fix = lambda v: None if pd.isna(v) else bool(v) if isinstance(v, (bool, np.bool_)) else int(v) if isinstance(v, Real) and v == int(v) else v
    return cols, sorted(str([fix(v) for v in row]) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(oracle.sql(registry.ORACLE_SQL[name]).df())


def test_no_row_holds_a_thread(spark, oracle, tmp_path, monkeypatch):
    """Long threads are written element by element, and read as what SQL says; one of them has no ledger rows, one no rows but those."""
    events = pd.DataFrame({"event_id": [*range(3000), *range(3001, 3041, 2), 4000], "user_id": [7] * 3000 + [8] * 20 + [9]})
    events = events.assign(ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(events.event_id, unit="s"), event_type="x", value=1.0, props="{}")
    events.assign(ts=events.ts.astype("datetime64[us]")).to_parquet(tmp_path / "events.parquet", index=False)
    longest, put = [], journals.put

    def told(rows, *rest):
        longest.append(rows.agg(F.max(F.length("line"))).first()[0])
        put(rows, *rest)

    monkeypatch.setattr(journals, "put", told)
    got = plain(journals.journal_threads(spark, str(tmp_path)).toPandas())
    assert longest and max(longest) < 400
    sql = registry.ORACLE_SQL["journal_threads"]
    assert got == plain(oracle.sql(sql.replace("FROM events)", f"FROM '{tmp_path}/events.parquet')")).df())
    assert len(got[1]) == 3021


def test_running_totals_on_more_rows(spark):
    """Totals of zero between others, which the smallest tables don't have."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{LARGER}/events.parquet'")
    name = "cumulative_delta"
    assert plain(registry.QUERIES[name](spark, LARGER).toPandas()) == plain(con.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name, order", [
    ("daily_usage", ["day", "client", "provider", "model"]),
    ("activity_daily_client", ["period", "series"]),
    ("activity_weekly_provider", ["period", "series"]),
    ("top_periods", ["period", "series"]),
    ("period_totals", ["period"]),
    ("session_summaries", ["-ended_at_unix_ms", "source_object_id", "session_id"]),
    ("model_usage", ["-total_tokens", "provider", "model"]),
    ("source_health", ["adapter_id", "installation_id", "source_object_id"]),
    ("source_reconciliation", ["source_object_id"]),
    ("cross_check", ["adapter_id", "reference"]),
])
def test_result_order(spark, name, order):
    rows = registry.QUERIES[name](spark, SF).collect()
    key = lambda r: [(v is not None, -v if c[0] == "-" and v is not None else v or "") for c in order for v in [r[c.lstrip("-")]]]
    assert len(rows) > 1 and rows == sorted(rows, key=key)


def test_due_sources_in_order(spark):
    objects = spark.createDataFrame([("s2", "i1"), ("s1", "i1"), ("s3", "i0"), ("s4", "i2")], "id string, installation_id string")
    installations = spark.createDataFrame([("i0", "b", True), ("i1", "a", True), ("i2", "a", False)], "id string, adapter_id string, enabled boolean")
    runs = spark.createDataFrame([("s1", "completed", "replace", 5)], "source_object_id string, status string, mode string, finished_unix_ms long")
    due = lambda now: [r["source_object_id"] for r in queries.due_sources(objects, installations, runs, now, 10).collect()]
    assert due(15) == ["s1", "s2", "s3"] and due(14) == ["s2", "s3"]


def test_references_in_a_given_order(spark):
    totals = spark.createDataFrame([("a", 5), ("b", 7)], "adapter_id string, total_tokens long")
    stated = spark.createDataFrame([("b", "x", 7), ("a", "x", 5), ("a", "z", 4), ("a", "y", None), ("a", "w", 5)], "adapter_id string, reference string, expected_total long")
    got = queries.cross_check(totals, stated, ["z", "y"]).collect()
    assert [(r["adapter_id"], r["reference"], r["status"]) for r in got] == [("a", "z", "mismatch"), ("a", "y", "unavailable"), ("a", "w", "match"), ("a", "x", "match"), ("b", "x", "match")]


def test_latest_parent(spark):
    child = spark.createDataFrame([(1, "k", 10), (2, "k", 5), (3, "k", None), (4, None, 9), (9, "k", 20), (5, "j", 1)], "child long, id string, at long")
    parent = spark.createDataFrame([(9, "k", 3), (8, "k", 10), (8, "k", 4), (7, "k", 2), (6, None, 1), (5, "j", 1), (99, "k", None)], "parent long, id string, begun long")
    got = {r["child"]: r["parent"] for r in sequences.latest_parent(child, parent, "id", "at", "begun", "child", "parent").collect()}
    assert got == {1: 9, 2: 9, 3: None, 4: None, 9: 8, 5: None}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_money(spark):
    texts = ["0.000000001", "1.25", "12e-3", "1.0000000000", "0", "-0.1", "0.0000000001", "18446744074", "abc", None, "1e-30", "18446744073.709551615"]
    got = column(spark, texts, "string", money.parse_nanos)
    assert [int(r["nanos"]) if r["nanos"] is not None else r["error"] for r in got] == [1, 1250000000, 12000000, 1000000000, 0, "negative", "too_precise", "out_of_range", "invalid", "invalid", "too_precise", 18446744073709551615]
    assert column(spark, [120000000, 3000000000, 1, 0], "long", money.usd_text) == ["0.12", "3", "0.000000001", "0"]
    assert column(spark, [1_234_567_499, 1_234_567_500, 5_000_000_000], "long", money.format_usd) == ["$1.234567", "$1.234568", "$5.00"]
    assert column(spark, [1, 0], "long", lambda x: money.ratio_percent(F.lit(2), x * 3)) == ["66.66%", "N/A"]
    assert column(spark, [1234567], "long", money.thousands) == ["1,234,567"]
    assert column(spark, [2**63 - 1], "long", lambda x: money.add_exact(x, x, x)) == [None]
    assert int(column(spark, [2**63 - 1], "long", lambda x: money.add_saturating(x, F.lit(str(2**64 - 1)).cast("decimal(20,0)")))[0]) == 2**64 - 1


def test_time(spark):
    assert [str(x) for x in column(spark, [-1, 0, 86_400_000], "long", timeutil.day)] == ["1970-01-01", "1970-01-01", "1970-01-02"]
    assert [str(x) for x in column(spark, [1704585600000], "long", timeutil.week_start)] == ["2024-01-01"]
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00.123456+01:00", "2024-01-01", "x", None], "string", timeutil.rfc3339_millis) == [1704067200000, 1704067200123, None, None, None]
    assert column(spark, [1770983410.1234, -1.0, float("nan"), None], "double", timeutil.seconds_millis) == [1770983410123, None, None, None]
    assert column(spark, [1787046083000], "long", timeutil.compact_text) == ["20260818-094123"]
    assert column(spark, [-5, 61_000, 3_720_000], "long", timeutil.duration_text) == ["0m 0s", "1m 1s", "1h 2m"]


def test_identity(spark):
    uuid = "00000000-0000-4000-8000-000000000001"
    assert column(spark, [f"rollout-2024-01-01T00-00-00-x_{uuid}.jsonl", f"rollout-2024-01-01T00-00-00-{uuid}.jsonl", "rollout-a.jsonl"], "string", identity.rollout_id) == [uuid, uuid, None]
    assert column(spark, [f"/a/session_q/{uuid}/wire.jsonl", "/a/session_q/b/wire.jsonl", "/a/b/wire.jsonl"], "string", identity.session_of_path) == [uuid, "q", None]
    assert column(spark, ["kimi-code/k", "__env__", "", "m"], "string", identity.plain_model) == ["k", None, None, "m"]
    assert column(spark, [1, 258], "long", identity.little_endian_u64) == [bytearray([1, *[0] * 7]), bytearray([2, 1, *[0] * 6])]
    pairs = [("cli", "Codex Desktop"), ("vscode", "codex_vscode"), ("vscode", None), ("vscode", "other"), ("cli", None)]
    rows = spark.createDataFrame(pairs, "s string, o string").select(identity.client_of(F.col("s"), F.col("o"))).collect()
    assert [r[0] for r in rows] == ["codex-desktop", "codex-vscode", "codex-vscode", "codex-cli", "codex-cli"]
    assert identity.fnv1a64(b"") == 0xCBF29CE484222325 and identity.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert [identity.locale_of(x) for x in ("zh-CN", "zh_TW", "zh", "en", None)] == ["zh", "zh", "zh", "en", "en"]


def test_increments(spark):
    total = [(100,), (100,), None, (130,), (40,), (0,), (50,)]
    last = [None, (7,), (10,), None, None, None, (9,)]
    rows = spark.createDataFrame([("a", i, t, x) for i, (t, x) in enumerate(zip(total, last, strict=True))], "k string, i int, total struct<n:bigint>, last struct<n:bigint>")
    got = sequences.increments(rows, ["k"], "i", ["n"]).orderBy("i").collect()
    assert [r["delta"]["n"] if r["emits"] else None for r in got] == [100, None, 10, 20, 40, None, 9]
    assert [r["reset"] for r in got] == [False, False, False, False, True, False, False]
