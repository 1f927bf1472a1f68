"""Row schemas and fixed values of the evidence model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names and numbers that results depend on.
SOURCE_TYPES = [
    "reddit", "twitter_x", "stocktwits", "sec_filing", "earnings_transcript", "financial_news", "govt_announcement",
    "company_blog", "github_commits", "job_postings", "market_prices", "financial_statements", "macro_data", "other",
]
BUCKETS = {
    "official": ["sec_filing", "earnings_transcript", "financial_statements", "govt_announcement"],
    "news": ["financial_news", "company_blog"],
    "social": ["reddit", "twitter_x", "stocktwits"],
    "alternative": ["github_commits", "job_postings", "market_prices", "macro_data"],
}
BULLISH, BEARISH = ["bullish", "very_bullish"], ["bearish", "very_bearish"]
SENTIMENT_SCORE = {"very_bearish": -1.0, "bearish": -0.5, "neutral": 0.0, "bullish": 0.5, "very_bullish": 1.0}
CREDIBILITY_WEIGHT = {"verified_official": 1.5, "high": 1.2, "medium": 1.0, "low": 0.6}
CREDIBILITY_SCORE = {"low": 0.25, "medium": 0.5, "high": 0.75, "verified_official": 1.0}
RATINGS = ["STRONG_BUY", "BUY", "HOLD", "SELL", "STRONG_SELL"]
STOPWORDS = [
    "the", "is", "in", "it", "of", "to", "and", "a", "an", "for", "on", "with", "as", "at", "by", "from", "this", "that", "are", "be", "was", "were", "has", "have", "had", "its", "or", "but",
    "not", "all", "been", "we", "they", "their", "our", "can", "will", "may", "also", "more", "than", "about", "up", "out", "into", "would", "could", "should",
]
FALLBACK_TERMS = [
    "revenue", "earnings", "growth", "profit", "loss", "margin", "debt", "cash", "stock", "market", "price", "rate", "risk", "buy", "sell", "hold", "analyst", "forecast", "quarter",
]
BULLISH_WORDS = ["surge", "jump", "rally", "soar", "beat", "upgrade", "growth", "record"]
BEARISH_WORDS = ["drop", "fall", "decline", "crash", "miss", "downgrade", "cut", "warning"]
#: Sector: tickers, keywords, extra adapters, focus areas; the first that matches wins.
SECTORS = {
    "semiconductor_tech": (
        ["NVDA", "AMD", "INTC", "TSM", "AVGO", "MU", "ARM", "QCOM"], ["gpu", "chip", "semiconductor", "fab"], ["github_commits", "job_postings"],
        ["Capex & Fab Utilization", "GPU/AI Demand", "R&D Spend", "Developer Adoption"],
    ),
    "banking_finance": (
        ["JPM", "BAC", "C", "WFC", "GS", "MS", "HDFCBANK", "ICICIBANK"], ["bank", "nim", "npa", "loan"], [],
        ["Net Interest Margin (NIM)", "Tier 1 Capital Ratio", "Non-Performing Assets (NPA)", "Fed Rate Sensitivity"],
    ),
    "airline_transport": (
        ["DAL", "UAL", "AAL", "LUV", "INDIGO"], ["airline", "flight", "passenger"], [], ["Jet Fuel Prices (Brent Oil)", "Load Factor", "Passenger Yield", "Debt Load"],
    ),
    "saas_software": (
        ["CRM", "SNOW", "PLTR", "NOW", "DDOG"], ["saas", "arr", "cloud", "recurring"], ["github_commits", "job_postings"],
        ["ARR Growth", "Net Retention Rate (NRR)", "Gross Margin", "CAC Payback"],
    ),
}
HORIZONS = {
    "day_trading": ["today", "intraday", "day trade"],
    "short_term": ["swing", "next month", "short term"],
    "long_term": ["long term", "5 years", "10 years", "buy and hold"],
}
TEAMS = ["market_data", "fundamentals", "macro", "web_intelligence"]
ADAPTERS = ["sec_filings", "financial_news", "reddit", "twitter_x", "earnings_transcripts"]
#: Gap keyword: what a rewritten query adds; the first key that a gap contains counts.
ASPECT_TERMS = {
    "sec": "SEC 10-K 10-Q annual report",
    "filing": "SEC annual report quarterly filing EDGAR",
    "earnings": "earnings per share EPS guidance revenue beat miss",
    "fundamental": "P/E ratio book value free cash flow ROE EBITDA",
    "bearish": "risk factors headwinds downside price target sell analyst",
    "risk": "downside risk volatility bear case credit rating downgrade",
    "downside": "price target cut bear case risk factor sell-side",
    "bullish": "growth catalyst upside buy rating institutional accumulate",
    "growth": "revenue growth market share expansion AI opportunity",
    "catalyst": "upcoming catalyst product launch partnership acquisition",
    "news": "financial news analyst report Bloomberg Reuters WSJ",
    "social": "Reddit WallStreetBets Twitter StockTwits retail sentiment",
    "sentiment": "investor sentiment options flow institutional buying",
    "macro": "macroeconomic interest rate Fed inflation GDP recession",
    "rate": "Federal Reserve rate hike cut monetary policy yield curve",
    "recent": "latest Q3 Q4 2024 2025 recent news update",
    "stale": "most recent current latest update 2024 2025",
    "price": "stock price technical analysis support resistance momentum",
    "market": "market cap float short interest options chain",
}
LAST_RESORT = "SEC filing analyst rating fundamental macro risk"
GAPS = {
    "official": "Missing official sources (SEC filings, earnings transcripts)",
    "news": "Missing financial news coverage",
    "social": "Missing social sentiment signals (Reddit, Twitter)",
    "bear": "Insufficient bearish/risk evidence — need downside analysis",
    "bull": "Insufficient bullish evidence — need growth catalyst data",
    "stale": "Evidence is stale — need more recent news and filings",
}
#: Coverage weights and thresholds.
SUFFICIENT, BALANCE, LEAST_RELEVANCE, LEAST_RECENCY, LEAST_CONFIDENCE, DECAY = 0.65, 0.40, 0.40, 0.50, 0.55, 0.023
#: Metric: concept names, the first with data counts.
CONCEPTS = {
    "income": {
        "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "RevenueFromContractWithCustomerIncludingAssessedTax"],
        "cost_of_revenue": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
        "gross_profit": ["GrossProfit"],
        "operating_income": ["OperatingIncomeLoss"],
        "net_income": ["NetIncomeLoss"],
        "eps_basic": ["EarningsPerShareBasic"],
        "eps_diluted": ["EarningsPerShareDiluted"],
        "rd_expense": ["ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"],
    },
    "balance": {
        "total_assets": ["Assets"],
        "current_assets": ["AssetsCurrent"],
        "total_liabilities": ["Liabilities"],
        "current_liabilities": ["LiabilitiesCurrent"],
        "stockholders_equity": ["StockholdersEquity"],
        "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"],
        "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
        "shares_outstanding": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
    },
    "cashflow": {
        "operating_cashflow": ["NetCashProvidedByUsedInOperatingActivities"],
        "investing_cashflow": ["NetCashProvidedByUsedInInvestingActivities"],
        "financing_cashflow": ["NetCashProvidedByUsedInFinancingActivities"],
        "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "CapitalExpenditures"],
    },
}
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]
UNITS = ["USD", "shares", "USD/shares", "pure"]
#: Questions to measure retrieval by: query, ticker, keywords, source types, points of an answer.
GOLDEN = [
    (
        "What are NVIDIA's revenue growth drivers and valuation multiples?", "NVDA", ["revenue", "data center", "pe_ratio", "margin", "gpu"], ["sec_filing", "financial_statements", "financial_news"],
        ["Data Center revenue growth", "Gross margin expansion", "P/E valuation multiple"],
    ),
    (
        "What are Apple's main risks and debt to equity profile?", "AAPL", ["debt", "equity", "risk", "iphone", "headwinds"], ["sec_filing", "financial_statements"],
        ["Leverage ratio", "Hardware replacement cycles", "Supply chain concentration"],
    ),
]

EVIDENCE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "source_type", "title", "content", "url")],
        T.StructField("published", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("credibility", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        *[T.StructField(n, T.StringType()) for n in ("sentiment", "ticker", "sector")],
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("refs", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("parent_content", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("rag_score", T.DoubleType()),
    ]
)
EDGE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("source_id", "target_id", "edge_type")], T.StructField("weight", T.DoubleType()), T.StructField("description", T.StringType())])
PREDICTION = T.StructType(
    [
        T.StructField("prediction_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("rating", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in ("conviction", "price", "target_low", "target_high")],
        T.StructField("window_days", T.IntegerType()),
    ]
)
