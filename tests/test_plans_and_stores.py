"""Plans that are limited before the shuffle, the index, the store, plug-ins, and documented measures."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar import tables
from lodestar.operators import ann_index, embed, evaluate, postings, quant, retrieve
from lodestar.plans import engine, providers
from lodestar.plans import queries as q
from lodestar.sources import vector_store

SF = "/root/testdata/sf0.001"
ROWS = [(0, "NVIDIA 10-K annual report", "Blackwell Hopper GPU data center revenue growth", "NVDA"), (1, "Retail chatter", "people talk about gaming cards", "NVDA"), (2, "Phone maker news", "services revenue and phone sales", "AAPL")]


def corpus(spark):
    return spark.createDataFrame(ROWS, "id long, title string, content string, ticker string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j7_nearest", "o2_bm25_topk", "c2_hybrid_rrf", "c4_rerank", "o4_knn_topk", "o8_group_topn", "v5_index_search", "w12_rank_position"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    from lodestar.plans import extra_queries, model_queries, more_queries, stream_queries  # noqa: F401  they register their queries

    assert "WindowGroupLimit" in plan_of(q.QUERIES[name](spark, SF))


@pytest.mark.parametrize(("name", "most"), [("c2_hybrid_rrf", 0), ("c4_rerank", 1)])
def test_documents_are_not_read_again(spark, name, most):
    """The index has been written; candidates' texts are fetched once."""
    plan = plan_of(q.QUERIES[name](spark, SF))
    assert len(re.findall(r"FileScan parquet \[[^\]]*\][^\n]*documents\.parquet", plan)) <= most


def test_index_is_one_scan(spark, monkeypatch):
    """Of the documents, and nothing of theirs is shuffled by document and term."""
    plans, save = [], tables.save
    monkeypatch.setattr(tables, "save", lambda df, *a, **k: plans.append(plan_of(df)) or save(df, *a, **k))
    retrieve.text_index(q.ev(spark, SF))
    assert [len(re.findall(r"documents\.parquet", p)) for p in plans] == [1, 0, 0]
    keyed = [re.findall(r"Exchange (\w+)\(([^\n]*)", p) for p in plans]
    assert all(kind == "RoundRobinPartitioning" or "term" not in keys for kind, keys in keyed[0]) and not keyed[1]
    assert [kind for kind, _ in keyed[2]] == ["rangepartitioning"]


@pytest.mark.parametrize("name", ["a3_bm25", "v10_term_cosine", "c2_hybrid_rrf", "c4_rerank"])
def test_no_exchange_by_document_and_term(spark, name):
    keys = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan_of(q.QUERIES[name](spark, SF)))
    assert not [k for k in keys if re.search(r"\bid#", k) and "term" in k]


def test_many_queries_come_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda block: sorted((r.query_id, r.rank, r.id) for r in retrieve.nearest(v, asked, 3, block=block).collect())
    assert rows(7) == rows(1000)


def test_recall_of_the_cell_index(spark):
    """At least 0.70 at 5 with 50 vectors of 8 dimensions; through all cells exact."""
    rng = np.random.default_rng(42)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann_index.CellIndex.build(v)
    asked = rng.normal(size=(10, 8))
    a = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "query_id long, q array<double>")
    u, w = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None], asked / np.linalg.norm(asked, axis=1)[:, None]
    right = {i: set(np.argsort(-(u @ w[i]))[:5].tolist()) for i in range(10)}

    def recall(**settings):
        got = index.search(a, 5, **settings).collect()
        return sum(r.id in right[r.query_id] for r in got) / 50

    assert recall() >= 0.70
    assert recall(probes=99) == 1.0
    stats = index.stats().first()
    assert (stats.nodes, stats.dims) == (50, 8)
    assert index.insert(v.limit(9)).stats().first().nodes == 50  # known ids stay as they are
    zero = ann_index.CellIndex.build(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>"))
    far = {r.id: r.distance for r in zero.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>"), 3, probes=9).collect()}
    assert far[2] < 0.01 and far[3] > 1.5 and far[1] == 1.0


def test_embedding_strategies(spark):
    docs = corpus(spark).select("id", F.concat("title", F.lit(". "), "content").alias("text"))
    fitted = embed.TermEmbedder(64).fit(docs)
    v = {r.id: np.array(r.v) for r in docs.select("id", fitted.embed(F.col("text")).alias("v")).collect()}
    assert all(len(x) == fitted.dims and abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    asked = np.array(spark.createDataFrame([("Blackwell Hopper",)], "t string").select(fitted.embed(F.col("t")).alias("v")).first().v)
    assert max(v, key=lambda i: v[i] @ asked) == 0
    empty = embed.TermEmbedder().fit(docs.limit(0))
    assert len(empty.vocabulary) == 19 and empty.dims == 19
    with pytest.raises(ValueError, match="fit"):
        embed.TermEmbedder().embed(F.col("text"))
    router = embed.Router(embed.ModelEmbedder(None), embed.TermEmbedder(8))
    assert isinstance(router.chosen, embed.TermEmbedder) and router.available
    model = embed.ModelEmbedder(lambda texts: [[len(t), 0.0] for t in texts])
    assert docs.select(model.embed(F.col("text")).alias("v")).first().v == [1.0, 0.0]
    assert embed.signs("revenue", 40).tolist() == embed.signs("revenue", 64)[:40].tolist()


def test_store_upserts_searches_and_deletes(spark, tmp_path):
    """Three rows; filter by ticker; a deleted id is gone; a later session goes on."""
    path = f"file://{tmp_path}/store"
    store = vector_store.TableVectorStore(spark, path, embed.TermEmbedder(32))
    assert store.count() == 0 and store.delete([1]) == 0
    with pytest.raises(LookupError):
        store.search(retrieve.queries(spark, [(1, "x")]))
    assert store.upsert(corpus(spark)) == 3 and store.count() == 3
    asked = retrieve.queries(spark, [(1, "Blackwell Hopper"), (2, "phone revenue")])
    best = {r.query_id: r.title for r in store.search(asked, 1).collect()}
    assert "10-K" in best[1] and best[2] == "Phone maker news"
    assert {r.ticker for r in store.search(asked, 5, F.col("ticker") == "AAPL").collect()} == {"AAPL"}
    assert store.delete([1, 77]) == 1 and store.delete([1]) == 0 and store.count() == 2
    assert 1 not in {r.id for r in store.search(asked, 5).collect()}
    again = vector_store.TableVectorStore(spark, path, embed.TermEmbedder(32))
    assert again.upsert(corpus(spark).filter("id = 1").withColumn("title", F.lit("back"))) == 1
    assert again.count() == 3 and again.stats() == {"stored": 3, "live": 3, "deleted": 0}
    assert {r.id: r.title for r in again.live().collect()}[1] == "back"


def test_failed_changes_leave_the_store_usable(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = vector_store.TableVectorStore(spark, path, embed.TermEmbedder(32))
    store.upsert(corpus(spark))
    broken = corpus(spark).withColumn("title", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    (tmp_path / "store" / "rows-half").mkdir()  # a folder that no list names
    (tmp_path / "store" / "lists" / "2").mkdir()  # a list that was not finished
    assert store.count() == 3 and {r.title for r in store.live().collect()} == {r[1] for r in ROWS}
    assert store.upsert(corpus(spark).filter("id = 0").withColumn("title", F.lit("renewed"))) == 1
    assert {r.id: r.title for r in store.live().collect()}[0] == "renewed"
    version, listed = store._list()
    assert version == 2 and [x["kind"] for x in listed] == ["rows", "rows"]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store._put(2, listed)  # another change came first


def test_index_follows_the_store(spark, tmp_path, monkeypatch):
    """After the first search only new rows are embedded; replaced and deleted ones do not come out; compaction changes nothing."""
    store = vector_store.TableVectorStore(spark, f"file://{tmp_path}/store", embed.TermEmbedder(32))
    asked = retrieve.queries(spark, [(1, "Blackwell Hopper"), (2, "phone revenue"), (3, "gaming cards")])
    best = lambda: {r.query_id: (r.id, r.title) for r in store.search(asked, 1, probes=99).collect()}
    store.upsert(corpus(spark))
    assert best()[1][0] == 0
    built, added = [], []
    build, add = ann_index.VectorRetriever.build, ann_index.VectorRetriever.add
    monkeypatch.setattr(ann_index.VectorRetriever, "build", lambda self, rows: built.append(rows.count()) or build(self, rows))
    monkeypatch.setattr(ann_index.VectorRetriever, "add", lambda self, rows, **k: added.append(rows.count()) or add(self, rows, **k))
    store.upsert(spark.createDataFrame([(0, "renewed", "phone revenue", "NVDA"), (7, "more", "Blackwell Hopper Blackwell Hopper", "NVDA")], corpus(spark).schema))
    assert best()[1] == (7, "more") and (built, added) == ([], [2])
    assert len(store.search(asked, 9, probes=99).filter("query_id = 1").collect()) == 4  # each live id once
    store.delete([7])
    assert best()[1][0] != 7 and added == [2]
    before = sorted((r.query_id, r.rank, r.id, r.title) for r in store.search(asked, 9, probes=99).collect())
    store.compact()
    assert sorted((r.query_id, r.rank, r.id, r.title) for r in store.search(asked, 9, probes=99).collect()) == before and added == [2]
    assert len(store._list()[1]) == 1 and store.stats() == {"stored": 3, "live": 3, "deleted": 0}
    store.upsert(corpus(spark).filter("id = 2"))
    assert store.count() == 3 and len(best()) == 3 and added == [2, 1]
    store.reindex()
    assert len(best()) == 3 and built == [3]


def test_retriever_needs_an_index(spark):
    r = ann_index.VectorRetriever(embed.TermEmbedder(32))
    with pytest.raises(RuntimeError):
        r.retrieve(retrieve.queries(spark, [(1, "x")]))
    r.build(corpus(spark))
    assert r.stats().first().nodes == 3
    assert r.retrieve(retrieve.queries(spark, [(1, "Blackwell Hopper")]), 1).first().id == 0


def test_providers_and_teams(spark):
    def broken(**_):
        def ask(prompt):
            raise ConnectionError

        return ask

    providers.register_provider("Broken ", broken)
    providers.register_provider("silent", lambda **_: lambda prompt: "")
    providers.register_provider("echo", lambda prefix="": lambda prompt: prefix + prompt)
    assert providers.provider("ECHO", prefix="> ")("hi") == "> hi"
    assert providers.with_fallback(["broken", "silent", "echo"])("hi") == "hi"
    assert providers.with_fallback(["broken"])("hi") == providers.mock()("hi")
    with pytest.raises(ValueError, match="no provider"):
        providers.provider("nobody")
    e = corpus(spark).withColumn("source_type", F.when(F.col("id") == 0, "sec_filing").otherwise("reddit"))
    teams = [providers.TableTeam("a", e, ["sec_filing"]), providers.TableTeam("b", e, ["reddit"])]
    assert [r.id for r in providers.gather(spark, teams, "nvda", "q").orderBy("id").collect()] == [0, 1]
    with pytest.raises(ValueError, match="team"):
        providers.gather(spark, [], "nvda", "q")


def test_realized_prices_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=int(n))
    prices = [("AB"[i % 2], day(rng.integers(0, 40)), float(i)) for i in range(60)]
    prices = list({(t, ts): (t, ts, c) for t, ts, c in prices}.values())
    asked = [(i, "ABC"[i % 3], day(rng.integers(0, 45)), 5) for i in range(40)]
    p = spark.createDataFrame(prices, "ticker string, ts timestamp, close double")
    a = spark.createDataFrame(asked, "prediction_id int, ticker string, created_at timestamp, window_days int")
    want = {"latest": {}, "horizon": {}}
    for i, t, at, days in asked:
        later = sorted((ts, c) for x, ts, c in prices if x == t and ts >= at)
        want["latest"][i] = later[-1][1] if len(later) >= 2 else None
        past = [(ts, c) for ts, c in later if ts >= at + dt.timedelta(days=days)]
        want["horizon"][i] = past[0][1] if past else None
    for mode, right in want.items():
        assert {r.prediction_id: r.realized_price for r in evaluate.realized(a, p, mode=mode).collect()} == right


def test_calls_on_each_date_know_what_was_published(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, "A", t(2), "bullish", "high", 0.9), (2, "A", t(9), "bearish", "verified_official", 0.5), (3, "B", t(9), "bearish", "low", 0.4), (4, "A", t(30), "bearish", "low", 9.0)]
    e = spark.createDataFrame(rows, "id int, ticker string, published timestamp_ntz, sentiment string, credibility string, confidence double")
    prices = spark.createDataFrame([("A", t(1), 10.0), ("A", t(8), 20.0), ("B", t(3), 5.0)], "ticker string, ts timestamp_ntz, close double")
    dates = spark.createDataFrame([(t(5),), (t(12),), (t(19),)], "as_of timestamp_ntz")
    got = {(r.ticker, r.created_at.day): (r.rating, r.initial_price) for r in engine.calls_by_date(e, prices, dates).collect()}
    assert got == {("A", 5): ("STRONG_BUY", 10.0), ("A", 12): ("HOLD", 20.0), ("A", 19): ("HOLD", 20.0), ("B", 12): ("STRONG_SELL", 5.0), ("B", 19): ("STRONG_SELL", 5.0)}


def test_documented_measures(spark):
    year = spark.createDataFrame([("a", 1, 1.0, 10.0, 2.0, 5.0, 1.0, 9, 0.3, 0.5), ("a", 2, 1.0, 10.0, 2.0, 4.0, 1.1, 9, 0.4, 0.6)], "entity string, period int, net_income double, assets double, cash_flow double, debt double, current_ratio double, shares int, gross_margin double, turnover double")
    assert {r.period: r.f_score for r in quant.piotroski(year).collect()} == {1: 4, 2: 9}
    z = spark.createDataFrame([(1.0, 1.0, 0.2, 0.1, 0.1), (0.1, 0.1, 0.1, 0.1, 0.1)], "x1 double, x2 double, x3 double, x4 double, x5 double")
    assert {r.zone for r in quant.altman(z).collect()} == {"safe", "distress"}
    rows = [(g, float(i), float(i * i)) for g in "ab" for i in range(8)]
    ic = quant.information_coefficient(spark.createDataFrame(rows, "g string, signal double, outcome double"), ["g"]).first()
    assert ic.rank_ic == pytest.approx(1.0) and 0.9 < ic.ic < 1
    rng = np.random.default_rng(1)
    zs = rng.normal(size=400)
    xs = zs + 0.1 * rng.normal(size=400)
    ys = 3 * zs + 0.01 * rng.normal(size=400)
    p = quant.partial_effect(spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(xs, ys, zs, strict=True)], "g int, x double, y double, z double"), ["g"]).first()
    assert p.spurious and p.total > 2.5 and abs(p.effect) < 0.1
    w = quant.risk_parity(spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.3), (1, "c", None)], "g int, ticker string, volatility double"), ["g"])
    assert {r.ticker: r.weight for r in w.collect()} == {"a": pytest.approx(0.75), "b": pytest.approx(0.25), "c": None}
    assert quant.diversification(w, ["g"]).first().diversification == pytest.approx(1 - 0.75**2 - 0.25**2)
    assert spark.range(1).select(quant.kelly(F.lit(0.6), F.lit(1.0)).alias("f")).first().f == pytest.approx(0.2)
    assert quant.tangency(np.array([0.1, 0.2]), np.diag([0.01, 0.04])).tolist() == pytest.approx([2 / 3, 1 / 3])
    market = np.array([0.5, 0.5])
    prior = quant.black_litterman(np.diag([0.04, 0.04]), market, np.array([[1.0, 0.0]]), np.array([0.05]))
    assert prior.tolist() == pytest.approx([0.05, 0.05])
    ups = spark.createDataFrame([("a", i, 0.001 + 0.004 * (-1) ** i) for i in range(40)] + [("b", i, 0.06 * (-1) ** i) for i in range(40)], "ticker string, ts int, r double")
    assert {r.ticker: r.regime for r in quant.regimes(ups).collect()} == {"a": "BULL_TREND", "b": "HIGH_VOLATILITY_SIDEWAYS"}
    flat = spark.createDataFrame([("a", i, 5.0) for i in range(30)], "ticker string, ts int, close double")
    assert quant.kalman(flat).first().level == pytest.approx(5.0)
    paths = quant.jump_paths(spark.createDataFrame([("a",)], "ticker string"), 100.0, 0.0, 0.01, paths=300, steps=5).first()
    assert paths.p05 < paths.median < paths.p95 and 0.3 < paths.profit < 0.7


def test_saved_tables_need_a_shared_folder(spark):
    df = tables.save(spark.range(5))
    assert df.count() == 5 and tables.is_small(df, 5) and not tables.is_small(df, 4)


def test_long_only_portfolios_are_the_best():
    """The three assets of which clipping gets 0.653 and a grid 0.707; and optimality on random ones."""
    m, s = np.array([0.10, 0.06, 0.05]), np.array([[0.04, 0.036, 0.0], [0.036, 0.04, 0.0], [0.0, 0.0, 0.01]])
    w = quant.tangency(m, s)
    assert (w >= 0).all() and w.sum() == pytest.approx(1) and m @ w / np.sqrt(w @ s @ w) == pytest.approx(np.hypot(0.5, 0.5), abs=1e-6)
    rng = np.random.default_rng(0)
    for n in (1, 4, 30):
        x = rng.normal(size=(3 * n, n))
        m, s = rng.normal(size=n) + 0.2, x.T @ x / n
        y = quant.long_only(m, s)
        g = s @ y - m
        assert (y >= 0).all() and (np.abs(g[y > 0]) < 1e-6).all() and (g[y == 0] > -1e-6).all()
    assert quant.tangency(np.array([-1.0, -2.0]), np.eye(2)).tolist() == [0.5, 0.5] and len(quant.tangency(np.zeros(0), np.zeros((0, 0)))) == 0


def test_ranks_of_large_groups(spark):
    rng = np.random.default_rng(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("big", float(v)) for v in rng.integers(0, 60, 900)] + [("small", 2.0), ("small", 2.0), ("small", 1.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    try:
        got = {(r.g, r.x): r["rank"] for r in quant.average_ranks(df, "x", "g").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("big", "small"):
        xs = [x for k, x in rows if k == g]
        for x in set(xs):
            assert got[g, x] == sum(y < x for y in xs) + (xs.count(x) + 1) / 2
    plan = plan_of(quant.signal_decay(spark.createDataFrame([("a", i, float(i % 7), float(i % 5 + 1)) for i in range(60)], "ticker string, ts int, signal double, close double"), [1, 2]))
    assert not re.search(r"Window [^\n]*\[horizon#\d+\], \[(signal|outcome)", plan)


def test_predictions_without_ids_and_with_the_same(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    prices = spark.createDataFrame([("a", day(n), float(n)) for n in range(1, 20)], "ticker string, ts timestamp_ntz, close double")
    rows = [(1, "a", day(2), 3), (1, "a", day(5), 3), (None, "a", day(6), 1), (2, None, day(2), 1), (3, "a", None, 1), (4, "a", day(18), 9)]
    p = spark.createDataFrame(rows, "prediction_id int, ticker string, created_at timestamp_ntz, window_days int")
    got = sorted(((r.prediction_id or 0, r.realized_price) for r in evaluate.realized(p, prices, mode="horizon").collect()), key=str)
    assert got == sorted([(1, 5.0), (1, 8.0), (0, 7.0), (2, None), (3, None), (4, None)], key=str)


def test_texts_of_few_questions_are_not_dealt_by_question(spark):
    """Two questions would send all texts to two tasks, where Spark does not broadcast by itself."""
    from lodestar.plans import extra_queries  # noqa: F401  it registers the query

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.QUERIES["c17_golden_set"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "strategy=broadcast" in plan


def test_vectors_of_an_index_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def model(ids: pd.Series) -> pd.Series:
        made.add(len(ids))
        return pd.Series([[float(i), 1.0] for i in ids])

    index = ann_index.CellIndex.build(spark.range(40).select(F.col("id").alias("vec_id"), model("id").alias("embedding")))
    assert index.rows.count() == 40 and made.value == 40


def test_texts_behind_a_shuffle_are_shuffled_once(spark):
    """Neither to learn how many parts they have, nor to re-rank a few of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = q.ev(spark, SF)
        assert postings.spread(e) is e
        asked = retrieve.queries(spark, q.ASKED)
        candidates = e.filter("id < 3").select(F.lit(1).alias("query_id"), "id", F.lit(1).alias("rank"))
        plan = retrieve.rerank(candidates, e, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Filter [^\n]*doc_id#\d+L? IN \(", plan)
