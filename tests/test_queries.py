"""Every query of the log against its SQL in DuckDB."""

import duckdb
import pytest

from tidelog.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "lineitem")


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None).astype(str).replace(r"\.0$", "", regex=True)
    return df.sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.execute(SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_priority_paced_against_a_plain_loop(spark):
    from tidelog.operators import views
    from tidelog.plans import logs

    rows = [r for r in logs.messages(spark, SF).collect() if r.msg_id >= 101]
    now, step, window, left = logs.NOW, 3_600_000_000, 25 * 86_400_000_000, sorted(rows, key=lambda r: r.msg_id)
    want = []
    for k in range(60):
        t = now + k * step
        left = [r for r in left if r.expires_at is None or t < r.expires_at]
        if not left:
            break
        low = [r for r in left if r.priority == 0]
        pick = low[0] if low and t - low[0].ts >= window else max(left, key=lambda r: (r.priority, -r.msg_id))
        want.append((k, pick.msg_id))
        left.remove(pick)
    got = views.priority_paced(logs.messages(spark, SF), 101, now, step, 60, window).collect()
    assert sorted((r.k, r.msg_id) for r in got) == want


def test_index_floor_of_every_message(spark):
    from tidelog.plans import catalogue

    log = sorted((r.segment, r.msg_id) for r in catalogue._offsets(spark, SF).collect())
    index = [(r.segment, r.msg_id, r.offset) for r in QUERIES["sparse_index"](spark, SF).collect()]
    want = [(g, i, *max((x, o) for h, x, o in index if h == g and x <= i)) for g, i in log]
    got = sorted(tuple(r) for r in QUERIES["index_floor_lookup"](spark, SF).collect())
    assert got == want and len(got) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_payload_preview_of_every_document(spark, tmp_path):
    texts = [None, "", "short", "é", "a" * 100, "a" * 101, "é" * 50, "é" * 51, "a" + "é" * 50, "aa" + "漢" * 40, "\U0001f600" * 26, "a" * 99 + "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = [t if t is None else t.encode() for t in texts]
    want = [b if b is None else b if len(b) <= 100 else b[:100] + b"..." for b in raw]
    got = {r.doc_id: r.preview_hex for r in QUERIES["payload_preview"](spark, str(tmp_path)).collect()}
    assert got == {i: b if b is None else b.hex().upper() for i, b in enumerate(want)}


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_paced_dequeues_take_a_bounded_part_and_miss_nothing(spark):
    import random

    from tidelog.operators import views

    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50), rng.choice([0, 0, 1, 2]), rng.choice([None, rng.randint(90, 160)])) for i in range(1, 400)]
    log = spark.createDataFrame(rows, "msg_id long, ts long, priority byte, expires_at long")
    for step, window in ((3, 70), (1, 0), (0, 60)):
        left, want = [r for r in rows if r[3] is None or r[3] > 100], []
        for k in range(40):
            t = 100 + k * step
            left = [r for r in left if r[3] is None or t < r[3]]
            if not left:
                break
            low = next((r for r in left if r[2] == 0), None)
            pick = low if window and low and t - low[1] >= window else min(left, key=lambda r: (-r[2], r[0]))
            want.append((k, pick[0]))
            left.remove(pick)
        got = views.priority_paced(log, 1, 100, step, 40, window)
        assert sorted(tuple(r) for r in got.collect()) == want
