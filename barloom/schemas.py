"""Schemas of the curated tables and of the raw files, as DDL; nothing is inferred."""

DAILY = (
    "symbol string, date date, series string, isin string, open double, high double, low double, close double, "
    "prev_close double, volume bigint, traded_value double, trades bigint"
)
INDEX_DAILY = "index_name string, date date, open double, high double, low double, close double"
ACTIONS = (
    "symbol string, ex_date date, factor double, kind string, status string, implied double, subject string, "
    "source_ex_date date, applied boolean"
)
CONSTITUENTS = "index_name string, symbol string, name string, industry string, isin string"
FILINGS = "symbol string, subject string, exDate string"
FLOWS = "category string, date string, buyValue string, sellValue string, netValue string"
ARTICLES = (
    "uuid string, title string, description string, url string, source string, image_url string, published_at string, "
    "entities array<struct<symbol:string,sentiment_score:double>>"
)
CANDLES = "struct<d:array<string>,o:array<double>,h:array<double>,l:array<double>,c:array<double>,v:array<bigint>>"
PREFS = "struct<capital:double,riskPct:double,maxPos:double>"
