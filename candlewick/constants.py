"""Tables, word lists and thresholds the results depend on."""

# ---- fixed values: moving averages and oscillators ----
MA_PERIODS = (20, 50, 100, 150, 200)
RSI_PERIOD = 14
RSI_OVERBOUGHT = 70.0
RSI_OVERSOLD = 30.0
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
VOLUME_MA_PERIOD = 10
VOLUME_SPIKE_MULTIPLIER = 2.0

# ---- fixed values: price levels ----
RANGE_BARS = 252
TREND_BARS = 20
RETRACEMENTS = (
    ("0.0%", 0.0),
    ("23.6%", 0.236),
    ("38.2%", 0.382),
    ("50.0%", 0.5),
    ("61.8%", 0.618),
    ("78.6%", 0.786),
    ("100.0%", 1.0),
)
EXTENSIONS = (("127.2%", 1.272), ("161.8%", 1.618), ("261.8%", 2.618))
AT_LEVEL_TOLERANCE = 0.015

# ---- fixed values: momentum labels ----
MOMENTUM_LABELS = ((80, "Very Strong"), (60, "Strong"), (40, "Neutral"), (20, "Weak"))
MOMENTUM_LOWEST = "Very Weak"

# ---- fixed values: dual listings and exchange rate ----
DUAL_LISTED = (
    ("TEVA", "TEVA.TA"),
    ("NICE", "NICE.TA"),
    ("CHKP", "CHKP.TA"),
    ("AMDOCS", "DOX.TA"),
    ("CEVA", "CEVA.TA"),
    ("GILT", "GILT.TA"),
    ("RADCOM", "RDCM.TA"),
    ("TOWER", "TSEM.TA"),
    ("ORCL", "ORCL.TA"),
)
MIN_GAP_PCT = 0.5
FALLBACK_USD_ILS = 3.72

# ---- fixed values: competitors ----
COMPETITORS = (
    ("TEVA", ("MRK", "PFE", "AMGN")),
    ("NICE", ("VEEV", "CRM", "WDAY")),
    ("CHKP", ("PANW", "CRWD", "FTNT")),
    ("AMDOCS", ("ACN", "EPAM", "CTSH")),
    ("CEVA", ("MRVL", "QCOM", "ARM")),
    ("GILT", ("GIL", "HBI")),
    ("RADCOM", ("JNPR", "CSCO")),
    ("TOWER", ("TXN", "NXPI", "ON")),
    ("ORCL", ("SAP", "MSFT", "CRM")),
    ("AAPL", ("MSFT", "GOOGL", "META")),
    ("MSFT", ("AAPL", "GOOGL", "AMZN")),
    ("GOOGL", ("META", "MSFT", "AMZN")),
    ("AMZN", ("MSFT", "GOOGL", "BABA")),
    ("META", ("SNAP", "GOOGL", "PINS")),
    ("NVDA", ("AMD", "INTC", "QCOM")),
    ("SPY", ("QQQ", "IWM", "DIA")),
)

# ---- fixed values: exchange codes ----
EXCHANGES = (
    ("NYQ", "NYSE"),
    ("NYSEArca", "NYSE Arca"),
    ("NMS", "NASDAQ"),
    ("NGM", "NASDAQ"),
    ("NCM", "NASDAQ"),
)

# ---- fixed values: market snapshot (symbol, label, group, decimals, dollar sign) ----
SNAPSHOT = (
    ("SPY", "S&P 500", "equities", 2, True),
    ("VOO", "Vanguard S&P", "equities", 2, True),
    ("QQQ", "Nasdaq", "equities", 2, True),
    ("DIA", "Dow Jones", "equities", 2, True),
    ("IWM", "Russell 2000", "equities", 2, True),
    ("RSP", "S&P EW", "equities", 2, True),
    ("DX-Y.NYB", "DXY (USD)", "currency", 2, False),
    ("^VIX", "VIX", "currency", 2, False),
    ("TLT", "20Y Treasury", "bonds", 2, True),
    ("AGG", "Bonds (AGG)", "bonds", 2, True),
    ("GLD", "Gold", "commodities", 2, True),
    ("SLV", "Silver", "commodities", 2, True),
    ("USO", "WTI Oil", "commodities", 2, True),
    ("BTC-USD", "Bitcoin", "crypto", 0, True),
    ("ETH-USD", "Ethereum", "crypto", 0, True),
)
DEFAULT_GROUP = "crypto"

# ---- fixed values: sector funds ----
SECTORS = (
    ("XLK", "Technology"),
    ("XLV", "Healthcare"),
    ("XLF", "Financials"),
    ("XLE", "Energy"),
    ("XLI", "Industrials"),
    ("XLY", "Cons. Discretionary"),
    ("XLP", "Cons. Staples"),
    ("XLC", "Communication"),
    ("XLB", "Materials"),
    ("XLRE", "Real Estate"),
    ("XLU", "Utilities"),
)

# ---- fixed values: watchlists of the reports ----
PREVIEW_WATCHLIST = ("AAPL", "MSFT", "NVDA", "SPY", "QQQ")
REPORT_WATCHLIST = ("AAPL", "MSFT", "NVDA", "GOOGL", "SPY")

# ---- fixed values: news ----
POSITIVE_WORDS = ("surge", "gains", "profit", "growth", "record", "bullish", "beat", "upgrade")
NEGATIVE_WORDS = (
    "drop", "loss", "crisis", "bearish", "miss", "downgrade", "investigation", "fine",
)
EARNINGS_WORDS = (
    "earnings", "beats", "misses", "results", "revenue", "eps", "quarterly", "profit",
)
HIGH_IMPACT_WORDS = ("earnings", "acquisition", "merger", "fda", "deal", "buyout")
SEARCH_QUERIES = {
    "en": ("{} stock news", "{} earnings analysis"),
    "he": ("{} מניה", "אנליזה {}"),
}
FRESH_SECONDS = 172_800
TOP_HEADLINES = 5
FEED_ITEMS = 8
FIRST_FEED_ITEMS, SECOND_FEED_ITEMS = 10, 5
MAX_PER_SOURCE = 2
SEARCH_RESULTS = 15
SNIPPET_CHARS = 200
HEADLINE_SNIPPET_CHARS = 150
PAGE_CHARS = 5000
FINANCIAL_SITES = (
    "globes.co.il",
    "bizportal.co.il",
    "cnbc.com",
    "reuters.com",
    "bloomberg.com",
    "marketwatch.com",
    "themarker.com",
    "calcalist.co.il",
    "sec.gov",
    "tase.co.il",
)

# ---- fixed values: time to live in seconds ----
TTL_SECONDS = {
    "quote": 60,
    "news": 900,
    "fundamentals": 14_400,
    "earnings": 3_600,
    "timeframe": 3_600,
    "sectors": 600,
    "signal": 120,
}

# ---- fixed values: sessions (local clock) ----
NEW_YORK, JERUSALEM = "America/New_York", "Asia/Jerusalem"
NYSE_HOURS = ("09:30:00.000000", "16:00:00.000000")
TASE_HOURS = ("10:00:00.000000", "17:25:00.000000")
TASE_FRIDAY_CLOSE = "15:45:00.000000"
TASE_PREOPEN = "09:45:00.000000"

# ---- fixed values: lookback per bar size ----
LOOKBACK = {"1d": "1y", "1wk": "2y", "1mo": "5y"}
PERIODS = {
    "1d": "1 day",
    "5d": "5 days",
    "1mo": "1 month",
    "3mo": "3 months",
    "6mo": "6 months",
    "1y": "1 year",
    "2y": "2 years",
    "5y": "5 years",
}
