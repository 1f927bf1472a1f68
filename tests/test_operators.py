"""Operators on small inputs with hand-computed results, and pandas or NumPy cross-checks."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar import schema as S
from lodestar.functions import scores as M
from lodestar.functions import text as X
from lodestar.functions import vectors as V
from lodestar.operators import committee, compress, critic, evaluate, features, filters, market, memory, retrieve
from lodestar.plans import engine, loop, planner
from lodestar.sources import filings, generators, stores
from lodestar.streaming import events as streams

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 6, 1)
COLUMNS = "id long, source_type string, title string, content string, ticker string, credibility string, confidence double, sentiment string, published timestamp_ntz"


def evidence(spark, *rows):
    base = {"source_type": "sec_filing", "title": "t", "content": "c", "ticker": "NVDA", "credibility": "medium", "confidence": 0.8, "sentiment": "neutral", "published": NOW}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | r)[n] for n in names) for i, r in enumerate(rows)], COLUMNS)


def at(when):
    return F.lit(when).cast("timestamp_ntz")


def one(df):
    return df.first().asDict()


CORPUS = [
    {"title": "NVIDIA 10-K annual report", "content": "Blackwell Hopper GPU data center revenue growth", "sentiment": "very_bullish", "credibility": "verified_official", "confidence": 0.98},
    {"title": "Retail chatter", "content": "people talk about gaming cards", "source_type": "reddit", "credibility": "low", "confidence": 0.3, "sentiment": "bearish"},
    {"title": "Phone maker news", "content": "services revenue and phone sales", "source_type": "financial_news", "ticker": "AAPL", "sentiment": "bullish"},
]


def test_filters(spark):
    e = evidence(spark, *CORPUS).withColumn("tags", F.when(F.col("id") == 0, F.array(F.lit("filing"))).otherwise(F.array(F.lit("x"))))
    assert [r.id for r in e.filter(filters.metadata_filter("aapl")).collect()] == [2]
    assert [r.id for r in e.filter(filters.metadata_filter(tags=["filing", "other"])).collect()] == [0]
    assert e.filter(filters.metadata_filter()).count() == 3
    assert stores.without(e, e.filter("id = 1"), "id").count() == 2
    later = evidence(spark, {"published": dt.datetime(2023, 12, 15)}, {"published": dt.datetime(2024, 6, 1)})
    assert [r.id for r in filters.as_of(later, at("2024-01-01")).collect()] == [0]
    assert filters.as_of(later, None).count() == 2
    days = spark.createDataFrame([("2024-1-5",), ("2024-01-05",), ("nonsense",)], "s string").select(filters.parse_date(F.col("s")).cast("date").cast("string").alias("d"))
    assert [r.d for r in days.collect()] == ["2024-01-05", "2024-01-05", None]


def test_tokenizers(spark):
    r = one(spark.createDataFrame([("Étion dans çouelle GPU-2 $18.1B x_y é-$5 foo-aé",)], "s string").select(X.rank_tokens(F.col("s")).alias("rank"), X.term_tokens(F.lit("The cats sat on a mat99")).alias("term"), X.words(F.col("s")).alias("words")))
    assert "étion" in r["words"] and "18" in r["rank"] and "-$5" in r["rank"] and "foo-" in r["rank"]
    assert r["term"] == ["cats", "sat", "mat99"]


def test_rerank_prefers_verified(spark):
    e = evidence(spark, CORPUS[0] | {"content": "market outlook"}, CORPUS[1] | {"content": "market outlook"})
    asked = retrieve.queries(spark, [(1, "market outlook")])
    candidates = e.select(F.lit(1).alias("query_id"), "id", (1 - F.col("id")).alias("rank"))
    assert [r.id for r in retrieve.rerank(candidates, e, asked).orderBy("place").collect()] == [0, 1]


def test_sparse_and_hybrid_find_the_filing(spark):
    e = evidence(spark, *CORPUS)
    asked = retrieve.queries(spark, [(1, "Blackwell Hopper")])
    assert "10-K" in retrieve.hybrid(e, asked, 3).orderBy("rank").join(e, "id").orderBy("rank").first().title
    repeated = retrieve.queries(spark, [(1, "revenue"), (2, "revenue revenue")])
    scores = {(r.query_id, r.id): r.score for r in retrieve.bm25(e, repeated).collect()}
    assert scores[2, 0] == pytest.approx(2 * scores[1, 0])
    n, df, tf, length = 3, 2, 1, 10
    lengths = [len(x) for x in (["nvidia", "10-k", "annual", "report", "blackwell", "hopper", "gpu", "data", "center", "revenue", "growth"],)]
    assert scores[1, 0] > 0 and lengths[0] == 11 and n > df > tf and length
    restricted = retrieve.bm25(e, repeated, where=F.col("ticker") == "AAPL")
    assert {r.id for r in restricted.collect()} == {2}
    assert {(r.query_id, r.id): r.score for r in restricted.collect()}[1, 2] == pytest.approx(scores[1, 2])


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(50, [0.0] * 8)], "vec_id long, embedding array<float>")
    got = retrieve.nearest(v, v.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(3):
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(1 - u @ u[q], kind="stable")[:5].tolist()
    assert [r.distance for r in got if r.id == r.query_id] == pytest.approx([0, 0, 0], abs=1e-9)
    zero = v.filter("vec_id = 50").select(V.normalize(F.col("embedding")).alias("z")).first().z
    assert zero == [0.0] * 8


def test_retrieval_measures(spark):
    got = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 5, 0)], "query_id int, id long, rank int")
    truth = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, id long")
    rows = {r.query_id: r for r in evaluate.retrieval_quality(got, truth, 2).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].ndcg) == (1.0, 1.0, 1.0)
    assert (rows[2].recall, rows[2].precision, rows[2].ndcg) == (1.0, 0.0, 0.0)


def test_faithfulness(spark):
    a = spark.createDataFrame([("Data center revenue reached $18.1B in the quarter. Unicorns dance nightly!\n", "data center revenue was $18.1b this quarter"), ("", "x")], "answer string, context string")
    assert [r.faithfulness for r in evaluate.faithfulness(a).collect()] == [0.5, 1.0]


def test_context_steps(spark):
    rows = [
        {"content": "NVIDIA reported record data center revenue", "credibility": "low", "confidence": 0.5},
        {"content": "nvidia  reported record data center REVENUE ", "credibility": "medium"},
        {"content": "NVIDIA reported data center revenue record high", "credibility": "verified_official", "published": NOW - dt.timedelta(days=20)},
        {"content": "something else entirely about airlines"},
    ]
    e = evidence(spark, *rows)
    single = compress.drop_copies(e)
    assert sorted(r.id for r in single.collect()) == [0, 2, 3]
    clusters = compress.leader_clusters(single, group=["ticker"], least=0.4)
    assert {r.id: r.leader for r in clusters.collect()} == {0: 0, 2: 0, 3: 3}
    assert sorted(r.id for r in compress.best_of_clusters(clusters, group=["ticker"]).collect()) == [2, 3]
    packed = compress.compress(e, "data center revenue", at(NOW.isoformat()), group=["ticker"], least=0.4)
    assert [r.id for r in packed.orderBy("pick").collect()] == [2, 3]
    assert compress.within_budget(e.withColumn("place", F.col("id")), 70).count() == 2
    pairs = {(r.a, r.b) for r in compress.similar_pairs(e, least=0.7).collect()}
    assert (0, 1) in pairs and not any(3 in p for p in pairs)


def leaders_brute(sets, least):
    leaders, out = [], []
    for i, s in enumerate(sets):
        hit = next((k for k in leaders if s and sets[k] and len(s & sets[k]) / len(s | sets[k]) >= least), None)
        if hit is None:
            leaders.append(i)
        out.append(i if hit is None else hit)
    return out


def test_leader_clusters_in_order(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 7))) for _ in range(80)]
    got = {r.id: r.leader for r in compress.leader_clusters(evidence(spark, *[{"content": t} for t in texts]), group=["ticker"], least=0.6).collect()}
    assert [got[i] for i in range(80)] == leaders_brute([set(t.split()) for t in texts], 0.6)


def test_critic(spark):
    diverse = [{"source_type": s, "sentiment": m, "published": NOW - dt.timedelta(days=5)} for s, m in zip(["sec_filing", "financial_news", "reddit", "job_postings"] * 2, ["bullish", "bearish", "very_bullish", "very_bearish"] * 2, strict=True)]
    same = [{"source_type": "reddit", "sentiment": "bullish", "published": NOW - dt.timedelta(days=5)}] * 5
    a, b = (one(critic.coverage(evidence(spark, *rows).withColumn("score", F.lit(0.9)), ["ticker"], at(NOW.isoformat()))) for rows in (diverse, same))
    assert a["coverage"] > b["coverage"] and a["sufficient"] and a["gaps"] == []
    assert a["recency"] == round(math.exp(-0.023 * 5), 4) and a["diversity"] == 1.0 and a["balance"] == 1.0
    assert b["gaps"] == [S.GAPS["official"], S.GAPS["news"], S.GAPS["bear"]]
    assert "SEC filing" in critic.refined_query("q", b["gaps"])
    assert critic.refined_query("q", []) == "q"


def test_planner_and_rewriting(spark):
    asked = spark.createDataFrame([("nvda", "GPU demand"), ("JPM", "loan book"), ("DAL", "next month"), ("XYZ", "warrant terms today"), ("XYZ", "plain")], "ticker string, query string")
    rows = planner.plan(asked).collect()
    assert [r.sector for r in rows] == ["semiconductor_tech", "banking_finance", "airline_transport", "saas_software", "general_equity"]
    assert [r.horizon for r in rows] == ["medium_term", "medium_term", "short_term", "day_trading", "medium_term"]
    assert "github_commits" in rows[0].adapters and "github_commits" not in rows[1].adapters
    gap = [S.GAPS["stale"]]
    assert planner.rewrite(spark, "q", gap, 1, "nvda") == "q"
    assert planner.rewrite(spark, "q", gap, 2, "nvda") == f"NVDA q {S.ASPECT_TERMS['filing']}"
    assert planner.rewrite(spark, "q sheet", gap, 3).endswith("fundamental analysis")
    assert planner.rewrite(spark, "q", ["nothing known"], 2) == f"q {S.LAST_RESORT}"
    assert planner.rewrite(spark, "q", gap, 2, "nvda", lambda prompt: '"newest filings of the year"\nmore') == "newest filings of the year"
    assert planner.rewrite(spark, "q", gap, 2, "nvda", lambda prompt: 1 / 0) == f"NVDA q {S.ASPECT_TERMS['filing']}"
    assert planner.rewrite(spark, "q", gap, 1, "nvda", lambda prompt: "never asked for") == "q"


def test_committee(spark):
    e = evidence(spark, {"sentiment": "bullish", "credibility": "verified_official", "confidence": 0.98}, {"sentiment": "bearish", "confidence": 0.70}, {"ticker": "ZZ"})
    price = spark.createDataFrame([("NVDA", 125.0)], "ticker string, price double")
    rows = {r.ticker: r for r in committee.judge(e, price).collect()}
    r = rows["NVDA"]
    assert (r.ratio, r.rating, r.conviction, r.upside, r.downside, r.entry_low, r.entry_high, r.risk_reward) == (2.1, "BUY", 0.81, 156.25, 106.25, 118.75, 127.5, 1.67)
    assert (rows["ZZ"].ratio, rows["ZZ"].rating, rows["ZZ"].price) == (1.0, "HOLD", 100.0)
    assert one(committee.case(e, filters.is_bullish()))["labels"] == ["[SEC_FILING] t"]


def test_reflection_and_accuracy(spark):
    r = spark.createDataFrame([(1, "BUY", 120.0, 135.0), (2, "BUY", 120.0, 105.0), (3, "HOLD", 0.0, 5.0)], "id int, rating string, initial_price double, actual_price double")
    rows = evaluate.reflect(r).orderBy("id").collect()
    assert [(x.change, x.success) for x in rows] == [(12.5, True), (-12.5, False), (0.0, True)]
    s = one(evaluate.reflection_summary(evaluate.reflect(r.filter("id < 3"))))
    assert (s["accuracy"], s["calibration"], s["biases"]) == (50.0, 0.85, [evaluate.BIASES["buy"]])
    assert one(evaluate.reflection_summary(evaluate.reflect(r.limit(0))))["calibration"] == 1.0
    p = spark.createDataFrame([(1, "BUY", 0.9, 100.0, 120.0), (2, "BUY", 0.8, 200.0, 180.0)], "prediction_id int, rating string, conviction double, initial_price double, realized_price double")
    a = one(evaluate.accuracy(evaluate.judged(p)))
    assert (a["hit_rate"], a["conviction_winning"], a["conviction_losing"]) == (50.0, 0.9, 0.8)
    assert a["brier"] == pytest.approx((0.01 + 0.64) / 2)


def test_realized_modes(spark):
    prices = spark.createDataFrame([("A", dt.datetime(2024, 1, d), float(d)) for d in (1, 5, 9, 20)] + [("B", dt.datetime(2024, 1, 5), 1.0)], "ticker string, ts timestamp, close double")
    p = spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 2), 5), (2, "B", dt.datetime(2024, 1, 2), 5)], "prediction_id int, ticker string, created_at timestamp, window_days int")
    assert {r.prediction_id: r.realized_price for r in evaluate.realized(p, prices).collect()} == {1: 20.0, 2: None}
    assert {r.prediction_id: r.realized_price for r in evaluate.realized(p, prices, mode="horizon").collect()} == {1: 9.0, 2: None}


def test_indicators_against_pandas(spark):
    rng = np.random.default_rng(1)
    close = pd.Series(100 + rng.normal(size=90).cumsum())
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c), 10 + i) for i, c in enumerate(close)] + [("B", dt.datetime(2024, 1, 1), 7.0, 1)]
    p = spark.createDataFrame(rows, "ticker string, ts timestamp, close double, volume long")
    s = {r.ticker: r for r in market.summary(p).collect()}
    d = close.diff().fillna(0)
    gain, loss = d.clip(lower=0).rolling(14, min_periods=1).mean(), (-d).clip(lower=0).rolling(14, min_periods=1).mean()
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    a = s["A"]
    assert a.rsi == pytest.approx((100 - 100 / (1 + gain / loss.replace(0, 1e-9))).iloc[-1])
    assert (a.macd, a.signal) == pytest.approx((line.iloc[-1], line.ewm(span=9, adjust=False).mean().iloc[-1]))
    assert a.sma50 == pytest.approx(close.rolling(50, min_periods=1).mean().iloc[-1])
    assert a.bb_high == pytest.approx((close.rolling(20).mean() + 2 * close.rolling(20).std()).iloc[-1])
    assert a.volatility == pytest.approx(close.pct_change().std() * math.sqrt(252) * 100)
    assert s["B"].volatility == 20.0 and s["B"].bb_high is None
    f = {r.ticker: r for r in features.price_features(p).collect()}["A"]
    assert (f.latest_price, f.volatility) == pytest.approx((close.iloc[-1], close.pct_change().std(ddof=0)))
    x = spark.createDataFrame([("P", dt.datetime(2024, 1, i + 1), float(v)) for i, v in enumerate([100, 102, 105, 103, 108, 112])], "ticker string, ts timestamp, close double")
    r = one(features.price_features(x))
    assert r["latest_price"] == 112.0 and r["momentum"] > 1


def test_evidence_features(spark):
    e = evidence(spark, {"credibility": "verified_official", "sentiment": "very_bullish", "confidence": 0.98}, {"credibility": "high", "sentiment": "bullish", "confidence": 0.9})
    t = spark.createDataFrame([("NVDA",), ("NONE",)], "ticker string")
    rows = {r.ticker: r for r in features.evidence_features(e, t).collect()}
    assert rows["NVDA"].evidence_count == 2.0 and rows["NVDA"].avg_credibility == 0.875 and rows["NVDA"].lineage == ["sec_filing"]
    assert rows["NONE"].evidence_count == 0.0 and rows["NONE"].avg_sentiment_score is None
    z = one(features.normalized(features.evidence_features(e)))["normalized"]
    assert sum(z.values()) == pytest.approx(0, abs=1e-3)


def test_filings(spark):
    raw = '{"facts": {"us-gaap": {"SalesRevenueNet": {"units": {"USD": [{"val": 5, "end": "2023-12-31", "form": "10-K", "fy": 2023, "fp": "FY", "filed": "2024-02-01"}, {"val": 9, "end": "2024-03-31", "form": "10-Q", "filed": "2024-05-01"}]}}, "Revenues": {"units": {"USD": [{"val": 1, "end": "2020-12-31", "form": "8-K"}]}}, "NetIncomeLoss": {"units": {"shares": [{"val": 7, "end": "2023-12-31", "form": "10-K"}], "USD": [{"val": 1, "end": "2023-12-31", "form": "10-K"}]}}}}}'
    facts = filings.select_facts(filings.flatten_facts(spark.createDataFrame([("A", raw)], "ticker string, json string")), "ticker")
    assert [(r.metric, r.value) for r in facts.orderBy("metric", F.desc("end_date")).collect()] == [("net_income", 1.0), ("revenue", 9.0), ("revenue", 5.0)]
    assert {r.metric: r.value for r in filings.latest_value(facts, ["ticker", "metric"]).collect()} == {"net_income": 1.0, "revenue": 5.0}
    assert one(filings.ratios(facts, "ticker"))["net_margin"] == 20.0
    growth = {r.metric: r.growth for r in filings.adjacent_growth(facts, ["ticker", "metric"]).collect()}
    assert growth == {"net_income": None, "revenue": pytest.approx(0.8)}


def test_stores_and_memory(spark, tmp_path):
    e = evidence(spark, *CORPUS)
    again = stores.upsert([e, e.filter("id = 1").withColumn("title", F.lit("new"))], "id")
    assert {r.id: r.title for r in again.collect()}[1] == "new" and again.count() == 3
    stores.write_json(e, str(tmp_path / "e"))
    assert stores.read_json(spark, str(tmp_path / "e"), e.schema).exceptAll(e).count() == 0
    assert {r.id: r.ticker for r in stores.read_evidence(spark, str(tmp_path / "e")).collect()} == {"0": "NVDA", "1": "NVDA", "2": "AAPL"}
    spark.createDataFrame([("a", "b", 0.5)], "source_id string, target_id string, weight double").write.json(str(tmp_path / "edges"))
    assert stores.read_edges(spark, str(tmp_path / "edges")).first()[:4] == ("a", "b", None, 0.5)
    assert stores.read_predictions(spark, str(tmp_path / "edges")).columns == S.PREDICTION.names
    for _ in range(2):
        stores.append_registry(e, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
    reports = spark.createDataFrame([("NVDA", NOW, ["0", "1"])], "ticker string, ts timestamp_ntz, evidence_ids array<string>")
    rollup = memory.report_rollup(reports)
    asked = spark.createDataFrame([("NVDA",), ("ZZ",)], "ticker string")
    assert {r.ticker: (r.known, r.cached) for r in memory.lookup(asked, rollup).collect()} == {"NVDA": (True, 2), "ZZ": (False, 0)}
    assert [r.id for r in memory.delta(e, rollup).collect()] == [2]
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 9, 1.0)], "source_id long, target_id long, weight double")
    assert one(memory.graph_stats(e, edges)) == {"nodes": 3, "edges": 1, "weight": 1.0}


def test_generators_repeat(spark):
    t = spark.createDataFrame([("A",), ("B",)], "ticker string")
    a, b = (generators.synthetic_prices(t.repartition(n), 40, dt.date(2024, 1, 1)) for n in (1, 3))
    assert a.exceptAll(b).count() == 0
    r = np.log([x.close for x in a.filter("ticker = 'A'").orderBy("ts").collect()])
    assert 0.008 < np.diff(r).std() < 0.03
    assert one(generators.macro_reading(spark, vix=30.0))["sentiment"] == "bearish"
    fan = generators.fan(spark, 100.0, 0.0, 0.02).collect()
    assert all(x.p05 <= x.median <= x.p95 for x in fan)


def test_loop_and_engine(spark):
    e = spark.createDataFrame([], COLUMNS)
    assert loop.run(e, "q", "NVDA", at("2024-06-01")).rounds == []
    rows = [r | {"title": f"{r['title']} {k}", "published": NOW - dt.timedelta(days=k)} for k in range(4) for r in CORPUS]
    docs = evidence(spark, *rows)
    prices = spark.createDataFrame([("NVDA", dt.datetime(2024, 5, 1), 120.0), ("NVDA", dt.datetime(2024, 7, 1), 500.0)], "ticker string, ts timestamp_ntz, close double")
    out = engine.analyze(docs, prices, "Blackwell revenue growth", "nvda", at("2024-06-01"), rounds=2)
    assert out["research"].rounds[0]["query"] == "Blackwell revenue growth"
    assert out["research"].ids and set(out["research"].ids) <= set(range(12))
    d = one(out["decision"])
    assert d["ticker"] == "NVDA" and d["price"] == 120.0
    dates = generators.walk_forward(spark, dt.date(2024, 5, 31), dt.date(2024, 6, 7), 7)
    calls = engine.calls_by_date(docs, prices, dates)
    assert calls.filter("ticker = 'NVDA'").count() == 2


def test_streams_match_batch(spark, tmp_path):
    path = tmp_path / "in"
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(path))
    stream = streams.distinct_events(streams.read_events(spark, str(path), files_per_trigger=9))
    got = streams.run_available(stream, str(tmp_path / "seen"), str(tmp_path / "c1"))
    assert got.count() == batch.count()
    windows = streams.run_available(streams.tumbling(streams.read_events(spark, str(path), files_per_trigger=9)), str(tmp_path / "windows"), str(tmp_path / "c2"), "complete")
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert {(str(r.start), r.event_type, r.n) for r in windows.collect()} == {(str(r.window.start), r.event_type, r["count"]) for r in want.collect()}


def test_scores(spark):
    r = one(spark.range(1).select(M.rating(F.lit(3.0)).alias("a"), M.rating(F.lit(0.5)).alias("b"), M.conviction(F.lit(0.4)).alias("c"), M.guarded(F.lit(1.0), F.lit(0.0), 7.0).alias("d"), M.or_default(F.lit(0.0), 5.0).alias("e")))
    assert r == {"a": "STRONG_BUY", "b": "SELL", "c": 0.85, "d": 7.0, "e": 5.0}
