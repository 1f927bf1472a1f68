"""Evidence in batches: merged by key and version, the same whatever comes again."""

import datetime as dt

import pytest

from lodestar.streaming import delta

SCHEMA = "id long, ticker string, published timestamp_ntz, confidence double, revision int, note string"
DAY = dt.datetime(2024, 1, 3)


def row(i, revision=1, ticker="A", days=0, confidence=0.5, note="x"):
    return (i, ticker, DAY + dt.timedelta(days=days), confidence, revision, note)


def rows(log):
    return sorted((tuple(r) for r in log.rows().collect()), key=repr)


def counted(log):
    return sorted((r["ticker"], r["period"].date().isoformat(), r["n"], round(r["confidence"], 9)) for r in log.tiers().collect())


@pytest.fixture
def log(spark, tmp_path):
    return delta.EvidenceLog(spark, str(tmp_path / "log"))


def test_replays_change_nothing(spark, log):
    a = spark.createDataFrame([row(1), row(2, ticker="B"), row(2, ticker="B")], SCHEMA)
    b = spark.createDataFrame([row(2, 2, "A", 7, 0.9), row(3)], SCHEMA)
    assert log.merge(a, stream="s", number=0) == 2
    assert log.merge(b, stream="s", number=1) == 2
    seen, tiers, lists = rows(log), counted(log), log._list()[0]
    assert seen == sorted([row(1), row(2, 2, "A", 7, 0.9), row(3)], key=repr)
    assert tiers == [("A", "2024-01-01", 2, 0.5), ("A", "2024-01-08", 1, 0.9)]
    # a known number is passed over, the same rows under another are found stored
    assert log.merge(a, stream="s", number=0) == 0 and log._list()[0] == lists
    assert log.merge(b, stream="t", number=0) == 0
    assert log.merge(a) == 0
    assert (rows(log), counted(log)) == (seen, tiers)


def test_order_of_batches_does_not_matter(spark, tmp_path):
    batches = [[row(1), row(2, 3, days=1)], [row(1, 2, "B", confidence=0.1)], [row(2, 2, "C"), row(1, 4, days=9, confidence=0.7)]]
    out = []
    for i, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 2, 0, 1])):
        log = delta.EvidenceLog(spark, str(tmp_path / str(i)))
        for j in order:
            log.merge(spark.createDataFrame(batches[j], SCHEMA))
        out.append((rows(log), counted(log)))
    assert out[0] == out[1] == out[2]


def test_nulls_ties_and_empty_batches(spark, log):
    assert log.rows() is None and log.tiers() is None
    empty = spark.createDataFrame([], SCHEMA)
    assert log.merge(empty) == 0
    a = [(None, None, None, None, None, None), (None, "A", DAY, 0.5, 1, "null id"), (5, "A", DAY, None, None, "no version")]
    assert log.merge(spark.createDataFrame(a, SCHEMA)) == 2
    assert log.merge(spark.createDataFrame([(5, "A", DAY, 0.25, 1, "now"), (None, "A", DAY, 0.5, 1, "a tie")], SCHEMA)) == 1
    assert sorted(r["note"] for r in log.rows().collect()) == ["now", "null id"]
    assert counted(log) == [("A", "2024-01-01", 2, 0.375)]
    assert log.merge(empty) == 0


def test_a_failed_batch_leaves_no_trace(spark, log):
    log.merge(spark.createDataFrame([row(1)], SCHEMA), stream="s", number=0)
    put, log._put = log._put, None
    b = spark.createDataFrame([row(1, 2, "B"), row(2)], SCHEMA)
    with pytest.raises(TypeError):
        log.merge(b, stream="s", number=1)
    log._put = put
    assert rows(log) == [row(1)]
    assert log.merge(b, stream="s", number=1) == 2
    assert rows(log) == sorted([row(1, 2, "B"), row(2)], key=repr)


def test_changes_and_compaction(spark, log):
    log.merge(spark.createDataFrame([row(1), row(2)], SCHEMA), stream="s", number=0)
    at, _ = log.changes()
    assert log.changes(at)[1] is None
    log.merge(spark.createDataFrame([row(2, 2), row(1)], SCHEMA), stream="s", number=1)
    assert [r["id"] for r in log.changes(at)[1].collect()] == [2]
    before = rows(log), counted(log)
    log.compact()
    assert (rows(log), counted(log)) == before
    assert log.merge(spark.createDataFrame([row(9)], SCHEMA), stream="s", number=1) == 0
    assert log.merge(spark.createDataFrame([row(1, 0), row(3)], SCHEMA), stream="s", number=2) == 1


def test_large_batches_shuffle_and_agree(spark, log, monkeypatch):
    monkeypatch.setattr(delta.tables, "is_small", lambda df: False)
    log.merge(spark.createDataFrame([row(i) for i in range(50)], SCHEMA))
    assert log.merge(spark.createDataFrame([row(i, i % 3, days=7) for i in range(60)], SCHEMA)) == 26
    assert log.rows().count() == 60


def test_stream_goes_on_from_its_checkpoint(spark, log, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([row(1), row(2)], SCHEMA).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    assert delta.merge_available(stream(), log, str(tmp_path / "c"), "s") == 2
    assert delta.merge_available(stream(), log, str(tmp_path / "c"), "s") == 0
    spark.createDataFrame([row(2, 2), row(1)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert delta.merge_available(stream(), log, str(tmp_path / "c"), "s") == 1
    # from the start again, under a checkpoint of its own
    assert delta.merge_available(stream(), log, str(tmp_path / "again"), "again") == 0
    assert {(r["id"], r["revision"]) for r in log.rows().collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("small", [True, False])
def test_texts_are_read_where_they_are_asked_for_only(spark, log, monkeypatch, small):
    if not small:
        monkeypatch.setattr(delta.tables, "is_small", lambda df: False)
    log.merge(spark.createDataFrame([row(1), row(2), row(2), row(3, note="a"), row(3, note="b")], SCHEMA))
    assert log.merge(spark.createDataFrame([row(2, 2), row(2, 3, note="last"), row(3, 1), row(4)], SCHEMA)) == 2
    assert [(r["id"], r["revision"]) for r in sorted(log.rows().collect())] == [(1, 1), (2, 3), (3, 1), (4, 1)]
    assert "note" not in log.rows().select("id", "ticker")._jdf.queryExecution().executedPlan().toString()
