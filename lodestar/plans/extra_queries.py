"""Registered queries: index, store and embedding strategies, plug-in interfaces, documented-only measures, whole analyses."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import scores as M
from ..functions import text as X
from ..operators import ann_index, compress, embed, evaluate, filters, graph_index, market, quant, retrieve
from ..sources import generators, vector_store, views
from .queries import ASKED, CONTEXT_QUERY, FOLD_SQL, KEY_SQL, KNN_SQL, NOW, RSI_SQL, T, _contains, _rules, asking, at, ev, query, terms_sql, trust_sql, words_sql

KNN = KNN_SQL[1:].replace(" q AS", "WITH q AS", 1)

# ---- index, embeddings, store --------------------------------------------------


@query("v4_index_insert", "SELECT count(*) AS nodes, max(len(embedding))::INTEGER AS dims FROM embeddings")
def _(spark, d):
    e = T(spark, d, "embeddings")
    index = ann_index.CellIndex.build(e.filter("vec_id % 2 = 0")).insert(e)
    return index.stats().select("nodes", "dims")


@query("v5_index_search", f"{KNN} SELECT query_id, id, round(distance, 6) + 0.0 AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM s QUALIFY rank < 5")
def _(spark, d):
    """Through all cells, where the answer is exact; fewer cells are tested by recall."""
    e = T(spark, d, "embeddings")
    index = ann_index.CellIndex.build(e)
    found = index.search(asking(e), 5, probes=len(index.centroids))
    return found.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("v4_graph_insert", "SELECT count(*) AS nodes, max(len(embedding))::INTEGER AS dims, TRUE AS bounded FROM embeddings")
def _(spark, d):
    """Every third vector is inserted into the graph of the others; lists stay bounded."""
    e = T(spark, d, "embeddings")
    index = graph_index.GraphIndex.build(e.filter("vec_id % 3 <> 0")).insert(e)
    return index.stats().select("nodes", "dims", (F.col("longest") <= index.degree + 2).alias("bounded"))


@query("v5_graph_recall", "SELECT count(*) AS queries, TRUE AS enough, TRUE AS ranked FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    """The graph's answers against all rows': at least nine tenths of each query's five nearest, on average.

    The beam is as wide as the table's size asks for, judged by some of the queries with a margin above nine tenths.
    """
    e = T(spark, d, "embeddings")
    asked = asking(e)
    found, right = graph_index.GraphIndex.build(e).search(asked, 5, recall=0.95), retrieve.nearest(e, asked, 5)
    hits = found.join(right.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    each = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(hits, "query_id", "left")
    return each.agg(F.count(F.lit(1)).alias("queries"), (F.avg(F.coalesce("hits", F.lit(0))) >= 4.5).alias("enough"), F.every(F.col("n") == 5).alias("ranked"))


DIMS = 8
TERMS_OF = terms_sql("title || '. ' || substring(content, 1, 512)")
PROJECTION_SQL = f""", tx AS (SELECT id, {TERMS_OF} AS ts FROM evidence), nn AS (SELECT count(*) AS n FROM tx),
 tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tx) GROUP BY 1, 2),
 voc AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM tf, nn GROUP BY term, n ORDER BY count(*) DESC, term LIMIT 4096),
 w AS (SELECT id, md5(term || '|0') AS h, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
 x AS (SELECT id, {", ".join(f"sum(w * CASE WHEN substr(h, {j + 1}, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x{j}" for j in range(DIMS))} FROM w GROUP BY id),
 v AS (SELECT tx.id, {", ".join(f"coalesce(x{j}, 0) AS x{j}" for j in range(DIMS))} FROM tx LEFT JOIN x USING (id)),
 u AS (SELECT *, sqrt({" + ".join(f"x{j} * x{j}" for j in range(DIMS))}) AS l FROM v)"""


def _retriever(spark, d):
    return ann_index.VectorRetriever(embed.TermEmbedder(DIMS)).build(views.texts(spark, d))


@query("v8_projection", f"{PROJECTION_SQL.replace('substring(content, 1, 512)', 'content')} SELECT id, {', '.join(f'round(CASE WHEN l > 1e-10 THEN x{j} / l ELSE 0 END, 6) + 0.0 AS x{j}' for j in range(DIMS))} FROM u", "evidence")
def _(spark, d):
    """Of whole texts."""
    texts = views.texts(spark, d).select("id", F.concat("title", F.lit(". "), "content").alias("text"))
    v = texts.select("id", embed.TermEmbedder(DIMS).fit(texts).embed(F.col("text")).alias("v"))
    return v.select("id", *[(F.round(F.col("v")[j], 6) + 0.0).alias(f"x{j}") for j in range(DIMS)])


@query("e6_embedding_router", "SELECT doc_id AS id, round((len(text) + 1.0::DOUBLE) / sqrt((len(text) + 1.0::DOUBLE) * (len(text) + 1.0::DOUBLE) + 1), 9) AS x, round(1 / sqrt((len(text) + 1.0::DOUBLE) * (len(text) + 1.0::DOUBLE) + 1), 9) AS y FROM documents")
def _(spark, d):
    """The first strategy that is available, here a model given as a function."""
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    router = embed.Router(embed.ModelEmbedder(None), embed.ModelEmbedder(lambda texts: [[len(t) + 1.0, 1.0, 0.0] for t in texts]), embed.TermEmbedder())
    v = docs.select("id", router.fit(docs).embed(F.col("text")).alias("v"))
    return v.select("id", F.round(F.col("v")[0], 9).alias("x"), F.round(F.col("v")[1], 9).alias("y"))


@query("v11_retriever_stats", f"SELECT count(*) AS nodes, {DIMS}::INTEGER AS dims FROM documents")
def _(spark, d):
    return _retriever(spark, d).stats().select("nodes", "dims")


@query("c1_vector_store", "SELECT count(*) AS live, count_if(id % 3 = 0) AS renewed FROM evidence WHERE id % 7 <> 0", "evidence")
def _(spark, d):
    store, e = vector_store.TableVectorStore(spark, embedder=embed.TermEmbedder(DIMS)), ev(spark, d)
    store.upsert(e)
    store.upsert(e.filter("id % 3 = 0").withColumn("title", F.lit("renewed")))
    store.delete(e.filter("id % 7 = 0"))
    return store.live().agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("title") == "renewed").alias("renewed"))


@query("e1_store_search", f"{PROJECTION_SQL.replace('512', '600')}, qv AS (SELECT * FROM u WHERE id = 5), s AS (SELECT u.id, {' + '.join(f'u.x{j} * qv.x{j}' for j in range(DIMS))} AS dot, u.l * qv.l AS l FROM u, qv) SELECT e.id, e.ticker FROM s JOIN evidence e USING (id) WHERE e.ticker <> 'SRC3' QUALIFY row_number() OVER (ORDER BY CASE WHEN l > 1e-10 THEN 1 - dot / l ELSE 1 END, e.id) <= 10", "evidence")
def _(spark, d):
    """A filtered search of everything stored; the question is the text of one document."""
    store, e = vector_store.TableVectorStore(spark, embedder=embed.TermEmbedder(DIMS)), ev(spark, d)
    store.upsert(e)
    asked = e.filter("id = 5").select(F.lit(1).alias("query_id"), F.concat("title", F.lit(". "), F.substring("content", 1, 600)).alias("query"))
    return store.search(asked, 10, F.col("ticker") != "SRC3", probes=1 << 30).select("id", "ticker")  # through all cells


# ---- parts of composite operators ------------------------------------------------


@query("f6_context_cutoff", "SELECT ticker, count(*) AS n FROM evidence WHERE published <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1", "evidence")
def _(spark, d):
    return filters.as_of(ev(spark, d), at("2024-01-10")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


FIRST = 8
FEW_SQL = f"few AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY id) <= {FIRST})"


def _few(spark, d):
    """The first candidates of each ticker, as one retrieval returns them."""
    w = Window.partitionBy("ticker").orderBy("id")
    return ev(spark, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= FIRST)


WORDS = words_sql("title || ' ' || content")


@query("j11_pairwise_similarity", f""", {FEW_SQL}, w AS (SELECT ticker, id, {WORDS} AS w FROM few)
  SELECT a.ticker, a.id AS a, b.id AS b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 9) AS similarity
  FROM w a JOIN w b ON a.ticker = b.ticker AND a.id < b.id""", "evidence")
def _(spark, d):
    w = _few(spark, d).select("ticker", "id", X.word_set(F.concat("title", F.lit(" "), "content")).alias("w"))
    a, b = w.select("ticker", F.col("id").alias("a"), F.col("w").alias("wa")), w.select("ticker", F.col("id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, "ticker").filter("a < b").select("ticker", "a", "b", F.round(X.jaccard(F.col("wa"), F.col("wb")), 9).alias("similarity"))


@query("o9_curated_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events")
def _(spark, d):
    e = T(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return e.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("u3_distinct_adapters", "SELECT id, list_sort(list_distinct([" + ", ".join(f"'{a}'" for a in S.ADAPTERS) + "] || CASE WHEN id % 2 = 0 THEN ['github_commits', 'reddit'] ELSE [] END)) AS adapters FROM evidence", "evidence")
def _(spark, d):
    more = F.when(F.col("id") % 2 == 0, F.array(F.lit("github_commits"), F.lit("reddit"))).otherwise(F.array().cast("array<string>"))
    return ev(spark, d).select("id", F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(a) for a in S.ADAPTERS]), more))).alias("adapters"))


@query("e2_research_teams", "SELECT id, source_type FROM evidence WHERE ticker = 'SRC3' AND source_type IN ('sec_filing', 'financial_news', 'company_blog')", "evidence")
def _(spark, d):
    from . import providers

    e = ev(spark, d)
    teams = [providers.TableTeam("filings", e, ["sec_filing"]), providers.TableTeam("web", e, ["financial_news", "company_blog"])]
    return providers.gather(spark, teams, "src3", ASKED[0][1]).select("id", "source_type")


@query("e4_provider_fallback", "SELECT doc_id, 'second: ' || substring(text, 1, 30) AS answer FROM documents")
def _(spark, d):
    """Each document's beginning as a prompt: the first provider fails, the next is unknown, the third answers."""
    from . import providers

    def broken(**_):
        def ask(prompt):
            raise ConnectionError(prompt)

        return ask

    providers.register_provider("broken", broken)
    providers.register_provider("second", lambda **_: lambda prompt: f"second: {prompt}")
    prompts = T(spark, d, "documents").select("doc_id", F.substring("text", 1, 30).alias("prompt"))
    return providers.answers(prompts, providers.with_fallback(["broken", "absent", "second"])).select("doc_id", "answer")


@query("r1_progress_events", "SELECT unnest(['start', 'complete']) AS stage, unnest([0, 1])::INTEGER AS n")
def _(spark, d):
    from . import engine

    seen: list[tuple[str, int]] = []
    engine.analyze(ev(spark, d).filter("id < 40"), views.view(spark, d, "prices").withColumn("ticker", F.lit("SRC3")), ASKED[0][1], "src3", at("2024-01-31"), rounds=1, progress=lambda stage, _: seen.append((stage, len(seen))))
    return spark.createDataFrame(seen, "stage string, n int")


GOLDEN_SQL = ", g(query_id, keywords, sources) AS (VALUES " + ", ".join("({}, [{}], [{}])".format(i + 1, *(", ".join(f"'{x}'" for x in r[k]) for k in (2, 3))) for i, r in enumerate(S.GOLDEN)) + ")"


@query("c17_golden_set", f"""{GOLDEN_SQL}, r AS (SELECT (id % 2 + 1)::INTEGER AS query_id, source_type, lower(title || ' ' || content) AS t FROM evidence),
  h AS (SELECT g.query_id, any_value(g.keywords) AS keywords, any_value(g.sources) AS sources, list_distinct(flatten(list(list_filter(g.keywords, lambda k: contains(r.t, k))))) AS k, list_distinct(flatten(list(list_filter(g.sources, lambda s: s = r.source_type)))) AS s FROM g JOIN r USING (query_id) GROUP BY 1)
  SELECT query_id, round(len(k)::DOUBLE / len(keywords), 9) AS keywords_found, round(len(s)::DOUBLE / len(sources), 9) AS sources_found FROM h""", "evidence")
def _(spark, d):
    found = ev(spark, d).withColumn("query_id", (F.col("id") % 2 + 1).cast("int"))
    e = evaluate.expectations(found, evaluate.golden(spark))
    return e.select("query_id", F.round("keywords_found", 9).alias("keywords_found"), F.round("sources_found", 9).alias("sources_found"))


# ---- documented-only measures ----------------------------------------------------

BARS_SQL = ", bars AS (SELECT ticker, ts, seq, close, close * 1.02::DOUBLE AS high, close * 0.97::DOUBLE AS low FROM prices)"


def _bars(spark, d):
    return views.view(spark, d, "prices").select("ticker", "ts", "seq", "close", (F.col("close") * 1.02).alias("high"), (F.col("close") * 0.97).alias("low"))


@query("d_atr", f"""{BARS_SQL}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))
  SELECT ticker, seq, round(avg(tr) OVER (PARTITION BY ticker ORDER BY ts ROWS 13 PRECEDING), 9) AS atr FROM tr""", "prices")
def _(spark, d):
    return quant.atr(_bars(spark, d)).select("ticker", "seq", F.round("atr", 9).alias("atr"))


@query("d_pivots", f"""{BARS_SQL}, p AS (SELECT *, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)), q AS (SELECT *, (h + l + c) / 3 AS p FROM p)
  SELECT ticker, seq, round(p, 6) AS pivot, round(2 * p - l, 6) AS r1, round(2 * p - h, 6) AS s1, round(p + (h - l), 6) AS r2, round(p - (h - l), 6) AS s2 FROM q""", "prices")
def _(spark, d):
    return quant.pivots(_bars(spark, d)).select("ticker", "seq", *[F.round(c, 6).alias(c) for c in ("pivot", "r1", "s1", "r2", "s2")])


STATEMENT_SQL = """st AS (SELECT l_suppkey AS entity, year(l_shipdate) AS period, sum(l_extendedprice * l_discount) - 40000 AS net_income, sum(l_extendedprice) AS assets, sum(l_extendedprice * l_tax) - 30000 AS cash_flow,
  sum(l_quantity) AS debt, avg(l_discount) AS current_ratio, count(*) AS shares, avg(l_tax) AS gross_margin, avg(l_quantity) AS turnover FROM lineitem GROUP BY 1, 2)"""


def _statements(spark, d):
    li = T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period"))
    price = F.col("l_extendedprice")
    return li.agg(
        (F.sum(price * F.col("l_discount")) - 40000).alias("net_income"), F.sum(price).alias("assets"), (F.sum(price * F.col("l_tax")) - 30000).alias("cash_flow"), F.sum("l_quantity").alias("debt"),
        F.avg("l_discount").alias("current_ratio"), F.count(F.lit(1)).alias("shares"), F.avg("l_tax").alias("gross_margin"), F.avg("l_quantity").alias("turnover"),
    )


@query("d_piotroski", f"""WITH {STATEMENT_SQL}, r AS (SELECT entity, period, round(net_income, 4) AS net_income, assets, round(cash_flow, 4) AS cash_flow, debt, round(current_ratio, 9) AS current_ratio, shares, round(gross_margin, 9) AS gross_margin, round(turnover, 9) AS turnover FROM st)
  SELECT entity, period::INTEGER AS period, ((net_income > 0)::INT + coalesce((net_income / nullif(assets, 0) > 0)::INT, 0) + (cash_flow > 0)::INT + (cash_flow > net_income)::INT + coalesce((debt < lag(debt) OVER w)::INT, 0)
   + coalesce((current_ratio > lag(current_ratio) OVER w)::INT, 0) + coalesce((shares <= lag(shares) OVER w)::INT, 0) + coalesce((gross_margin > lag(gross_margin) OVER w)::INT, 0) + coalesce((turnover > lag(turnover) OVER w)::INT, 0))::INTEGER AS f_score
  FROM r WINDOW w AS (PARTITION BY entity ORDER BY period)""")
def _(spark, d):
    s = _statements(spark, d)
    s = s.withColumns({c: F.round(c, n) for c, n in (("net_income", 4), ("cash_flow", 4), ("current_ratio", 9), ("gross_margin", 9), ("turnover", 9))})
    return quant.piotroski(s)


@query("d_altman", "SELECT p_partkey, round(1.2::DOUBLE * p_size / 50 + 1.4::DOUBLE * 0.5 + 3.3::DOUBLE * p_retailprice / 5000 + 0.6::DOUBLE + 0.999::DOUBLE * 0.1, 6) AS z, CASE WHEN 1.2::DOUBLE * p_size / 50 + 1.4::DOUBLE * 0.5 + 3.3::DOUBLE * p_retailprice / 5000 + 0.6::DOUBLE + 0.999::DOUBLE * 0.1 > 2.99 THEN 'safe' WHEN 1.2::DOUBLE * p_size / 50 + 1.4::DOUBLE * 0.5 + 3.3::DOUBLE * p_retailprice / 5000 + 0.6::DOUBLE + 0.999::DOUBLE * 0.1 >= 1.81 THEN 'grey' ELSE 'distress' END AS zone FROM part")
def _(spark, d):
    r = T(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("x1"), F.lit(0.5).alias("x2"), (F.col("p_retailprice") / 5000).alias("x3"), F.lit(1.0).alias("x4"), F.lit(0.1).alias("x5"))
    return quant.altman(r).select("p_partkey", F.round("z", 6).alias("z"), "zone")


CHANGE_SQL = ", ch AS (SELECT ticker, ts, seq, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM prices)"


@query("d_tail_loss", f"{CHANGE_SQL}, v AS (SELECT ticker, quantile_cont(r, 0.05) AS v FROM ch GROUP BY 1) SELECT ticker, round(v, 9) AS var, round(avg(CASE WHEN r <= v THEN r END), 9) AS cvar FROM ch JOIN v USING (ticker) GROUP BY ticker, v", "prices")
def _(spark, d):
    return quant.tail_loss(views.view(spark, d, "prices")).select("ticker", F.round("var", 9).alias("var"), F.round("cvar", 9).alias("cvar"))


@query("d_downside", f"{CHANGE_SQL} SELECT ticker, round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 6) AS sortino, round(quantile_cont(r, 0.01), 9) AS var99 FROM ch GROUP BY 1", "prices")
def _(spark, d):
    return evaluate.drawdown(views.view(spark, d, "prices")).select("ticker", F.round("sortino", 6).alias("sortino"), F.round("var99", 9).alias("var99"))


@query("d_information_coefficient", """, s AS (SELECT ticker, volume::DOUBLE AS signal, lead(close) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS outcome FROM prices), k AS (SELECT * FROM s WHERE outcome IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY signal) + (count(*) OVER (PARTITION BY ticker, signal) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY ticker ORDER BY outcome) + (count(*) OVER (PARTITION BY ticker, outcome) - 1) / 2.0::DOUBLE AS b FROM k)
  SELECT ticker, count(*) AS n, round(corr(signal, outcome), 6) AS ic, round(corr(a, b), 6) AS rank_ic FROM r GROUP BY 1 HAVING count(*) > 2""", "prices")
def _(spark, d):
    w = Window.partitionBy("ticker").orderBy("ts")
    rows = views.view(spark, d, "prices").select("ticker", F.col("volume").cast("double").alias("signal"), (M.ratio(F.lead("close").over(w), F.col("close")) - 1).alias("outcome"))
    return quant.information_coefficient(rows, ["ticker"]).filter("n > 2").select("ticker", "n", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"))


@query("d_signal_decay", """, s AS (SELECT ticker, ts, volume::DOUBLE AS signal, h AS horizon, CASE h WHEN 1 THEN lead(close, 1) OVER w WHEN 2 THEN lead(close, 2) OVER w ELSE lead(close, 5) OVER w END / close - 1 AS outcome FROM prices, (SELECT unnest([1, 2, 5]) AS h) WINDOW w AS (PARTITION BY ticker, h ORDER BY ts)),
  k AS (SELECT * FROM s WHERE outcome IS NOT NULL) SELECT horizon::INTEGER AS horizon, count(*) AS n, round(corr(signal, outcome), 6) AS ic FROM k GROUP BY 1""", "prices")
def _(spark, d):
    rows = views.view(spark, d, "prices").withColumn("signal", F.col("volume").cast("double"))
    return quant.signal_decay(rows, [1, 2, 5]).select("horizon", "n", F.round("ic", 6).alias("ic"))


@query("d_partial_effect", """SELECT l_returnflag, round((covar_pop(l_quantity, l_extendedprice) * var_pop(l_discount) - covar_pop(l_quantity, l_discount) * covar_pop(l_discount, l_extendedprice)) / (var_pop(l_quantity) * var_pop(l_discount) - covar_pop(l_quantity, l_discount) ** 2), 4) AS effect,
  round(covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity), 4) AS total FROM lineitem GROUP BY 1""")
def _(spark, d):
    e = quant.partial_effect(T(spark, d, "lineitem"), ["l_returnflag"], x="l_quantity", y="l_extendedprice", z="l_discount")
    return e.select("l_returnflag", F.round("effect", 4).alias("effect"), F.round("total", 4).alias("total"))


KALMAN_SQL = """, ord AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n, count(*) OVER (PARTITION BY ticker) AS total FROM prices),
 kf AS (SELECT ticker, n, total, close AS x, 1.0::DOUBLE AS p FROM ord WHERE n = 1 UNION ALL
   SELECT o.ticker, o.n, o.total, kf.x + (kf.p + 0.001::DOUBLE) / (kf.p + 0.001::DOUBLE + 0.1::DOUBLE) * (o.close - kf.x), (1 - (kf.p + 0.001::DOUBLE) / (kf.p + 0.001::DOUBLE + 0.1::DOUBLE)) * (kf.p + 0.001::DOUBLE) FROM kf JOIN ord o ON o.ticker = kf.ticker AND o.n = kf.n + 1)"""


@query("d_kalman", f"{KALMAN_SQL} SELECT ticker, round(x, 6) AS level, round(p, 9) AS variance FROM kf WHERE n = total", "prices")
def _(spark, d):
    return quant.kalman(views.view(spark, d, "prices")).select("ticker", F.round("level", 6).alias("level"), F.round("variance", 9).alias("variance"))


def _changes(spark, d):
    return views.view(spark, d, "prices").select("ticker", "ts", market.change().alias("r"))


@query("d_garch", f"""{CHANGE_SQL}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n, count(*) OVER (PARTITION BY ticker) AS total, avg(r * r) OVER (PARTITION BY ticker) AS v0 FROM ch WHERE r IS NOT NULL),
  g AS (SELECT ticker, 0::BIGINT AS n, total, v0 AS v FROM k WHERE n = 1 UNION ALL SELECT k.ticker, k.n, k.total, 1e-6::DOUBLE + 0.1::DOUBLE * k.r * k.r + 0.85::DOUBLE * g.v FROM g JOIN k ON k.ticker = g.ticker AND k.n = g.n + 1) SELECT ticker, round(v, 6) AS variance FROM g WHERE n = total""", "prices")
def _(spark, d):
    return quant.garch(_changes(spark, d)).select("ticker", F.round("variance", 6).alias("variance"))


def _regimes_sql() -> str:
    keep, leave, names = 0.95, (1 - 0.95) / 2, list(quant.REGIMES)
    joint = [f"(g.p{i} * {keep - leave!r}::DOUBLE + {leave!r}::DOUBLE) * (exp(-((k.r - ({m!r}::DOUBLE)) * (k.r - ({m!r}::DOUBLE))) / ({2 * s * s!r}::DOUBLE)) / {s!r}::DOUBLE + 1e-300::DOUBLE)" for i, (m, s) in enumerate(quant.REGIMES.values())]
    best = "CASE " + " ".join(f"WHEN p{i} = greatest(p0, p1, p2) THEN '{n}'" for i, n in enumerate(names)) + " END"
    return f"""{CHANGE_SQL}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n, count(*) OVER (PARTITION BY ticker) AS total FROM ch WHERE r IS NOT NULL),
  g AS (SELECT ticker, 0::BIGINT AS n, total, 1 / 3.0::DOUBLE AS p0, 1 / 3.0::DOUBLE AS p1, 1 / 3.0::DOUBLE AS p2 FROM k WHERE n = 1 UNION ALL
    SELECT ticker, n, total, j0 / (j0 + j1 + j2), j1 / (j0 + j1 + j2), j2 / (j0 + j1 + j2) FROM (SELECT k.ticker, k.n, k.total, {joint[0]} AS j0, {joint[1]} AS j1, {joint[2]} AS j2 FROM g JOIN k ON k.ticker = g.ticker AND k.n = g.n + 1))
  SELECT ticker, {best} AS regime, round(greatest(p0, p1, p2), 6) AS probability FROM g WHERE n = total"""


@query("d_regimes", _regimes_sql(), "prices")
def _(spark, d):
    return quant.regimes(_changes(spark, d)).withColumn("probability", F.round("probability", 6))


@query("d_risk_parity", f"{CHANGE_SQL}, v AS (SELECT ticker, stddev_samp(r) AS s FROM ch GROUP BY 1), w AS (SELECT ticker, CASE WHEN s > 0 THEN 1 / s END / sum(CASE WHEN s > 0 THEN 1 / s END) OVER () AS w FROM v) SELECT count(*) AS n, round(1 - sum(w * w), 9) AS diversification FROM w", "prices")
def _(spark, d):
    spreads = _changes(spark, d).groupBy("ticker").agg(F.stddev_samp("r").alias("volatility")).withColumn("book", F.lit(1))
    weights = quant.risk_parity(spreads, ["book"])
    return weights.groupBy("book").agg(F.count(F.lit(1)).alias("n")).join(quant.diversification(weights, ["book"]), "book").select("n", F.round("diversification", 9).alias("diversification"))


RETURNS_SQL = """, pd AS (SELECT ticker % 20 AS ticker, CAST(ts AS DATE) AS day, ts, close FROM prices), dl AS (SELECT ticker, day, max_by(close, ts) AS close FROM pd GROUP BY 1, 2),
 rt AS (SELECT * FROM (SELECT ticker, day, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS r FROM dl) WHERE r IS NOT NULL)"""


def _returns(spark, d):
    return quant.daily_returns(views.view(spark, d, "prices").withColumn("ticker", F.col("ticker") % 20))


@query("d_covariance", f"{RETURNS_SQL}, x AS (SELECT ticker, day, r - avg(r) OVER (PARTITION BY ticker) AS x FROM rt), n AS (SELECT count(DISTINCT day) AS n FROM rt) SELECT a.ticker AS a, b.ticker AS b, round(sum(a.x * b.x) / (any_value(n) - 1), 6) AS covariance FROM x a JOIN x b USING (day), n GROUP BY 1, 2", "prices")
def _(spark, d):
    return quant.covariance(_returns(spark, d)).select("a", "b", F.round("covariance", 6).alias("covariance"))


@query("d_mean_variance", f"{RETURNS_SQL} SELECT count(DISTINCT ticker) AS assets, TRUE AS invested, TRUE AS long_only, TRUE AS optimal FROM rt", "prices")
def _(spark, d):
    """The conditions of the best portfolio: all is invested, nothing short, no asset would better it."""
    w = quant.mean_variance(_returns(spark, d))
    slack = F.when(F.col("weight") > 1e-9, F.abs("gradient")).otherwise(-F.col("gradient"))
    return w.agg(F.count(F.lit(1)).alias("assets"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("invested"), (F.min("weight") >= 0).alias("long_only"), (F.max(slack) < 1e-6).alias("optimal"))


@query("d_kelly", "SELECT o_orderkey, round(greatest(0.0::DOUBLE, ((o_orderkey % 100) / 100.0::DOUBLE * 2 - (1 - (o_orderkey % 100) / 100.0::DOUBLE)) / 2), 9) AS f FROM orders")
def _(spark, d):
    p = (F.col("o_orderkey") % 100).cast("double") / 100
    return T(spark, d, "orders").select("o_orderkey", F.round(quant.kelly(p, F.lit(2.0)), 9).alias("f"))


# ---- whole analyses ----------------------------------------------------------------


@query("c15_engine")
def _(spark, d):
    """The analysis of one question: the decision, with the sizes of what it rests on."""
    from . import engine

    prices = views.view(spark, d, "prices").select(F.concat(F.lit("SRC"), F.col("ticker") % 20).alias("ticker"), "ts", "close")
    out = engine.analyze(ev(spark, d), prices, ASKED[0][1], "src3", at("2024-01-31"))
    n = out["context"].agg(F.count(F.lit(1)).alias("context"))
    return out["decision"].crossJoin(n).select("ticker", "rating", "conviction", "price", "context", F.lit(len(out["research"].rounds)).alias("rounds"))


LEADERS_SQL = f""", w AS (SELECT ticker, id, {words_sql("content")} AS w, row_number() OVER (PARTITION BY ticker ORDER BY id) AS n FROM evidence),
 st AS (SELECT ticker, n, id, id AS leader, [{{'id': id, 'w': w}}] AS known FROM w WHERE n = 1 UNION ALL
   SELECT ticker, n, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(known, {{'id': id, 'w': words}}) ELSE known END
   FROM (SELECT w.ticker, w.n, w.id, w.w AS words, st.known,
     list_filter(st.known, lambda k: len(k.w) > 0 AND len(w.w) > 0 AND len(list_intersect(k.w, w.w)) >= 0.7 * (len(k.w) + len(w.w) - len(list_intersect(k.w, w.w))))[1].id AS hit
     FROM st JOIN w ON w.ticker = st.ticker AND w.n = st.n + 1))"""


@query("c8_leader_clusters", f"{LEADERS_SQL} SELECT ticker, id, leader FROM st", "evidence")
def _(spark, d):
    return compress.leader_clusters(views.texts(spark, d, ticker=True), group=["ticker"]).select("ticker", "id", "leader")


Q_WORDS = words_sql(f"'{CONTEXT_QUERY}'")


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def picks_sql(placed: str) -> str:
    """Greedy diversity over a table (ticker, id, place, w, q)."""
    return f"""sims AS (SELECT a.ticker, a.id, any_value(a.place) AS place, any_value({jaccard_sql("a.q", "a.w")}) AS rel, list({jaccard_sql("a.w", "b.w")} ORDER BY b.place) AS sims FROM {placed} a JOIN {placed} b ON a.ticker = b.ticker GROUP BY a.ticker, a.id),
 pk AS (SELECT ticker, id, 0 AS pick, [place] AS taken FROM sims WHERE place = 1 UNION ALL
   SELECT ticker, id, pick + 1, list_append(taken, place) FROM (SELECT s.ticker, s.id, s.place, pk.pick, pk.taken,
     row_number() OVER (PARTITION BY s.ticker ORDER BY 0.65::DOUBLE * s.rel - (1 - 0.65::DOUBLE) * list_max(list_transform(pk.taken, lambda t: s.sims[t])) DESC, s.place) AS r
     FROM pk JOIN sims s ON s.ticker = pk.ticker AND NOT list_contains(pk.taken, s.place) WHERE pk.pick < 19) WHERE r = 1)"""


@query("o7_diversify", f""", w AS (SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY id) AS place, {WORDS} AS w, {Q_WORDS} AS q FROM evidence),
 {picks_sql("w")}
 SELECT ticker, id, pick::INTEGER AS pick FROM pk""", "evidence")
def _(spark, d):
    placed = ev(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("id")))
    return compress.diversify(placed, CONTEXT_QUERY, group=["ticker"]).select("ticker", "id", "pick")


COMPRESS_SQL = f""", known AS (SELECT * FROM evidence WHERE published <= {NOW}), single AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY ticker, {KEY_SQL} ORDER BY id) = 1)
 {LEADERS_SQL.replace("FROM evidence", "FROM single")},
 best AS (SELECT single.* FROM single JOIN st USING (ticker, id) QUALIFY row_number() OVER (PARTITION BY ticker, leader ORDER BY {trust_sql()} * confidence DESC, id) = 1),
 scored AS (SELECT *, {WORDS} AS ws, {Q_WORDS} AS q, {trust_sql()} * confidence * exp(-0.05::DOUBLE * greatest((epoch_us({NOW}) - epoch_us(published)) / 86400e6::DOUBLE, 0.0::DOUBLE))
   * (1 + len(list_intersect({Q_WORDS}, {WORDS}))::DOUBLE / len({Q_WORDS})) * (1 + 0.3::DOUBLE * 0.5::DOUBLE) AS s FROM best),
 placed AS (SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY s DESC, id) AS place, ws AS w, q FROM scored), {picks_sql("placed")},
 tk AS (SELECT ticker, id, pick, CAST(len('Source: ' || source_type || ' | Title: ' || title || ' | Content: ' || content) // 4 + 10 AS BIGINT) AS tokens FROM pk JOIN evidence USING (ticker, id)),
 tt AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY ticker ORDER BY pick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM tk)
 SELECT ticker, id, pick::INTEGER AS pick, tokens, total FROM tt WHERE total <= 4000"""


@query("c7_compress", COMPRESS_SQL, "evidence")
def _(spark, d):
    return compress.compress(ev(spark, d), CONTEXT_QUERY, at("2024-01-31"), group=["ticker"]).select("ticker", "id", "pick", "tokens", "total")


GAP = r"[ \t\n\x0B\f\r]"


def sentences_sql(x: str) -> str:
    """Without look-behind: the character before a break is kept in front of a mark, and texts are split at the marks."""
    marked = f"regexp_replace({x}, '([!?\\n]){GAP}+|([a-zA-Z])\\.{GAP}+', '\\1\\2' || chr(57344), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(57344)), lambda s: regexp_replace(s, '^{GAP}+|{GAP}+$', '', 'g')), lambda s: len(s) > 5)"


@query("t16_sentences", f"SELECT id, len({sentences_sql('content')})::INTEGER AS sentences FROM evidence", "evidence")
def _(spark, d):
    return ev(spark, d).select("id", F.size(X.sentences(F.col("content"))).alias("sentences"))


@query("a21_faithfulness", f"""WITH a AS (SELECT conv_id, turn, {sentences_sql("text")} AS s FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, lower(string_agg(text, ' ')) AS c FROM conversations WHERE role <> 'assistant' GROUP BY 1),
  e AS (SELECT conv_id, turn, unnest(s) AS s FROM a), w AS (SELECT e.*, list_filter({words_sql("s")}, lambda x: len(x) > 3) AS w, c FROM e JOIN c USING (conv_id)),
  g AS (SELECT conv_id, turn, avg(CASE WHEN len(w) = 0 THEN 1.0::DOUBLE WHEN len(list_filter(w, lambda x: contains(c, x)))::DOUBLE / len(w) >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM w GROUP BY 1, 2)
  SELECT a.conv_id, a.turn, round(coalesce(f, 1.0::DOUBLE), 9) AS faithfulness FROM a JOIN c USING (conv_id) LEFT JOIN g USING (conv_id, turn)""")
def _(spark, d):
    c = T(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = T(spark, d, "conversations").filter("role <> 'assistant'").groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("context"))
    return evaluate.faithfulness(c.join(asked, "conv_id")).select("conv_id", "turn", F.round("faithfulness", 9).alias("faithfulness"))


def _sector_case(place: int) -> str:
    return "CASE sector " + " ".join("WHEN '{}' THEN [{}]::VARCHAR[]".format(n, ", ".join("'" + x + "'" for x in p[place])) for n, p in S.SECTORS.items()) + " ELSE []::VARCHAR[] END"


@query("c14_plan", f""", r AS (SELECT ticker, title AS query, {_rules({n: f"(upper(ticker) IN ({', '.join(repr(t) for t in p[0])}) OR {_contains('title', p[1])})" for n, p in S.SECTORS.items()}, 'general_equity')} AS sector,
  {_rules({n: _contains('title', w) for n, w in S.HORIZONS.items()}, 'medium_term')} AS horizon FROM evidence)
  SELECT upper(trim(ticker)) AS ticker, query, sector, horizon, [{", ".join(f"'{t}'" for t in S.TEAMS)}] AS teams, list_sort(list_distinct([{", ".join(f"'{a}'" for a in S.ADAPTERS)}]::VARCHAR[] || {_sector_case(2)})) AS adapters, {_sector_case(3)} AS focus FROM r""", "evidence")
def _(spark, d):
    from . import planner

    return planner.plan(ev(spark, d).select("ticker", F.col("title").alias("query")))


SUMMARY_DIGITS = {"sma20": 9, "sma50": 9, "sma200": 9, "rsi": 6, "macd": 6, "signal": 6, "histogram": 6, "volatility": 6, "volume_ratio": 6}
SUMMARY_SQL = f"""{FOLD_SQL}, m AS (SELECT ticker, f - s AS macd, g AS signal, f - s - g AS histogram FROM fold WHERE n = total){RSI_SQL.replace(", ch AS", ", cg AS").replace("FROM ch", "FROM cg")},
 lv AS (SELECT *, avg(close) OVER (w ROWS 19 PRECEDING) AS sma20, avg(close) OVER (w ROWS 49 PRECEDING) AS sma50, avg(close) OVER (w ROWS 199 PRECEDING) AS sma200, stddev_samp(close) OVER (w ROWS 19 PRECEDING) AS sd, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM rs WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
 vo AS (SELECT ticker, coalesce(stddev_samp(r) * sqrt(252) * 100, 20) AS volatility FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS r FROM prices) GROUP BY 1),
 vr AS (SELECT ticker, avg(CASE WHEN back <= 5 THEN volume END) / avg(volume) AS volume_ratio FROM lv GROUP BY 1)
 SELECT ticker, close, {", ".join(f"round({c}, {n}) AS {c}" for c, n in SUMMARY_DIGITS.items())}, round(sma20 - 2 * sd, 6) AS bb_low, round(sma20 + 2 * sd, 6) AS bb_high,
   CASE WHEN rsi > 70 THEN 'bearish' WHEN rsi < 30 THEN 'bullish' WHEN rsi >= 55 THEN 'bullish' WHEN rsi <= 45 THEN 'bearish' ELSE 'neutral' END AS sentiment
 FROM lv JOIN m USING (ticker) JOIN vo USING (ticker) JOIN vr USING (ticker) WHERE back = 1"""


@query("s18_market_summary", SUMMARY_SQL, "prices")
def _(spark, d):
    rows = market.summary(views.view(spark, d, "prices"))
    return rows.select("ticker", "close", *[F.round(c, n).alias(c) for c, n in (SUMMARY_DIGITS | {"bb_low": 6, "bb_high": 6}).items()], "sentiment")


def normal_sql(*key: str) -> str:
    u1, u2 = (f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join([*key, chr(39) + k + chr(39)])})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496" for k in "12")
    return f"sqrt(-2 * ln({u1})) * cos(2 * pi() * ({u2}))"


@query("s6_synthetic_prices", f"""WITH t AS (SELECT DISTINCT c_custkey::VARCHAR AS ticker FROM customer), s AS (SELECT ticker, d AS day, 4e-4::DOUBLE + 0.018::DOUBLE * {normal_sql('ticker', 'd')} AS step FROM t, range(30) AS r(d)),
  p AS (SELECT ticker, day, 100 * exp(sum(step) OVER (PARTITION BY ticker ORDER BY day)) AS close FROM s) SELECT ticker, CAST(DATE '2024-01-01' + day::INTEGER AS DATE) AS ts, round(close, 6) AS close, round(close * 1.015::DOUBLE, 6) AS high FROM p""")
def _(spark, d):
    rows = generators.synthetic_prices(T(spark, d, "customer").select(F.col("c_custkey").alias("ticker")), 30, date(2024, 1, 1))
    return rows.select("ticker", "ts", F.round("close", 6).alias("close"), F.round("high", 6).alias("high"))


@query("w18_fan", f""", s AS (SELECT p AS path, t AS step, (0.0004::DOUBLE - 0.018::DOUBLE * 0.018::DOUBLE / 2) + 0.018::DOUBLE * {normal_sql('p', 't', '0')} AS r FROM range(25) AS a(p), range(1, 61) AS b(t)),
  c AS (SELECT step, exp(sum(r) OVER (PARTITION BY path ORDER BY step)) AS price FROM s), l AS (SELECT step, list(price ORDER BY price) AS l FROM c GROUP BY 1), last AS (SELECT ticker, max_by(close, ts) AS price FROM prices GROUP BY 1)
  SELECT ticker, step::INTEGER AS step, round(price * l[2], 4) AS p05, round(price * l[13], 4) AS median, round(price * l[24], 4) AS p95 FROM last, l""", "prices")
def _(spark, d):
    fans = generators.fans(views.view(spark, d, "prices"), 0.0004, 0.018)
    return fans.select("ticker", "step", *[F.round(c, 4).alias(c) for c in ("p05", "median", "p95")])


DATES = "dates AS (SELECT unnest([TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-29']) AS as_of)"


@query("c13_backtest", f""", {DATES}, keys AS (SELECT DISTINCT doc_id % 20 AS k FROM documents), pr AS (SELECT 'SRC' || k AS ticker, ts, value AS close FROM events JOIN keys ON user_id % 20 = k),
 kn AS (SELECT e.*, as_of FROM evidence e JOIN dates ON published <= as_of),
 wt AS (SELECT ticker, as_of, sum(CASE WHEN sentiment IN ('bullish', 'very_bullish') THEN w ELSE 0 END) AS bull, sum(CASE WHEN sentiment IN ('bearish', 'very_bearish') THEN w ELSE 0 END) AS bear
   FROM (SELECT *, confidence * CASE WHEN credibility = 'verified_official' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM kn) GROUP BY 1, 2),
 ra AS (SELECT *, CASE WHEN bull = 0 AND bear = 0 THEN 1.0::DOUBLE WHEN bear = 0 THEN 3.0::DOUBLE ELSE round(bull / bear, 2) END AS ratio FROM wt),
 lp AS (SELECT ticker, as_of, arg_max(close, ts) AS price FROM pr JOIN dates ON ts <= as_of GROUP BY 1, 2),
 calls AS (SELECT ra.ticker, as_of AS created_at, CASE WHEN ratio >= 3 THEN 'STRONG_BUY' WHEN ratio >= 2 THEN 'BUY' WHEN ratio <= 0.3 THEN 'STRONG_SELL' WHEN ratio <= 0.5 THEN 'SELL' ELSE 'HOLD' END AS rating, coalesce(price, 100.0::DOUBLE) AS initial_price FROM ra LEFT JOIN lp USING (ticker, as_of)),
 rl AS (SELECT c.ticker, c.created_at, any_value(c.initial_price) AS initial_price, arg_max(p.close, p.ts) AS realized_price FROM calls c JOIN pr p ON p.ticker = c.ticker AND p.ts >= c.created_at GROUP BY 1, 2 HAVING count(*) >= 2),
 jd AS (SELECT *, (realized_price - initial_price) / initial_price * 100 AS change FROM rl WHERE initial_price > 0)
 SELECT ticker, count(*) AS calls, round(sum(change), 6) AS strategy, round((arg_max(realized_price, created_at) - arg_min(initial_price, created_at)) / arg_min(initial_price, created_at) * 100, 6) AS buy_hold FROM jd GROUP BY 1""", "evidence")
def _(spark, d):
    from . import engine

    dates = generators.walk_forward(spark, date(2024, 1, 8), date(2024, 1, 29), 7)
    keys = T(spark, d, "documents").select((F.col("doc_id") % 20).alias("k")).distinct()
    prices = T(spark, d, "events").join(keys, F.col("user_id") % 20 == F.col("k")).select(F.concat(F.lit("SRC"), F.col("k")).alias("ticker"), "ts", F.col("value").alias("close"))
    rows = engine.backtest(ev(spark, d), prices, dates)
    return rows.select("ticker", "calls", F.round("strategy", 6).alias("strategy"), F.round("buy_hold", 6).alias("buy_hold"))


def uniform_sql(*key: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


@query("d_jump_paths", f"""WITH s AS (SELECT n_name AS ticker, p, t, (4e-4::DOUBLE - 0.018::DOUBLE * 0.018::DOUBLE / 2) + 0.018::DOUBLE * {normal_sql("n_name", "p", "t", "'0'")} + CASE WHEN {uniform_sql("n_name", "p", "t", "'0'", "'7'")} < 0.01 THEN 0.05::DOUBLE * {normal_sql("n_name", "p", "t", "'1'")} ELSE 0.0::DOUBLE END AS r
    FROM nation, range(200) AS a(p), range(1, 31) AS b(t)), e AS (SELECT ticker, p, 100 * exp(sum(r)) AS x FROM s GROUP BY 1, 2)
  SELECT ticker, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(avg((x > 100)::INT), 6) AS profit FROM e GROUP BY 1""")
def _(spark, d):
    paths = quant.jump_paths(T(spark, d, "nation").select(F.col("n_name").alias("ticker")), 100.0, 4e-4, 0.018, paths=200)
    return paths.select("ticker", *[F.round(c, 6).alias(c) for c in ("p05", "median", "p95", "profit")])
