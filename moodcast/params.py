"""Parameters that change results. Defaults are the reference's behaviour.

Fixed values (must equal the reference for equal results), in natural order:
  retention window ............ 90 days
  minimum body length analysed  > 100 characters (strict)
  scoring gate ................ title_length >= 10 and selftext_length >= 100
  moving average frame ........ 4 rows (3 preceding and the current row)
  chart spans ................. 38 days, 24 hours
  default visible series ...... "nasdaq_index", "wallstreetbets"
  communities polled .......... wallstreetbets, bitcoin, stocks, StockMarket,
                                 investing, cryptocurrency, ethereum, altcoin
  newest posts per poll ....... 1000
  scorer version key .......... "SentimentAnalyzer_v1"
  freshness limits ............ posts 1 h, daily table 30 h, hourly table 12 h
  post URL base ............... "https://www.reddit.com"
  price series names .......... "nasdaq", "bitcoin"; chart key suffix "_index"
  sentiment label cut ......... +-0.05
"""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR = 3600
DAY = 86400

RETENTION_DAYS = 90
MIN_BODY_ANALYSED = 100
GATE_MIN_TITLE = 10
GATE_MIN_BODY = 100
SMA_ROWS = 4
DISPLAY_DAY = 38
DISPLAY_HOUR = 24
DEFAULT_VISIBLE = ("nasdaq_index", "wallstreetbets")
COMMUNITIES = ("wallstreetbets", "bitcoin", "stocks", "StockMarket",
               "investing", "cryptocurrency", "ethereum", "altcoin")
NEWEST_N = 1000
SCORER_VERSION = "SentimentAnalyzer_v1"
FRESHNESS_POSTS_S = 1 * HOUR
FRESHNESS_DAYS_S = 30 * HOUR
FRESHNESS_HOURS_S = 12 * HOUR
URL_BASE = "https://www.reddit.com"
PRICE_SERIES = ("nasdaq", "bitcoin")
PRICE_KEY_SUFFIX = "_index"
LABEL_CUT = 0.05

# Exact arithmetic: a composite is rounded once to this decimal (the natural
# log differs in the last bit between math libraries and CPUs), and sums add
# those decimals, so a result does not depend on row order, retries, AQE
# coalescing or the engine. |composite| < 22 for 32-bit scores.
COMPOSITE_DECIMAL = "decimal(18,9)"
# Sentence polarity lies in (-1, 1); nine places keep the error below 1e-9.
POLARITY_DECIMAL = "decimal(18,9)"
# Token values after the rules have at most ~11 decimals; twelve keep them exact.
VALENCE_DECIMAL = "decimal(18,12)"


@dataclass(frozen=True)
class AnalysisParams:
    """Everything one analysis run depends on; ``as_of`` replaces the clock."""

    as_of: int
    retention_days: int = RETENTION_DAYS
    min_body: int = MIN_BODY_ANALYSED
    sma_rows: int = SMA_ROWS
    # False: exact parity with the reference (oldest bucket cut mid-way).
    align: bool = False


@dataclass(frozen=True)
class ChartParams:
    display_day: int = DISPLAY_DAY
    display_hour: int = DISPLAY_HOUR
    visible: tuple = field(default=DEFAULT_VISIBLE)
    tz: str = "UTC"


def load_config(path: str) -> ChartParams:
    """SRC-10: the reference's JSON config (default visible series, chart
    spans) as parameters. A missing key keeps the default."""
    import json

    with open(path) as f:
        cfg = json.load(f)
    return ChartParams(display_day=int(cfg.get("display_day", DISPLAY_DAY)),
                       display_hour=int(cfg.get("display_hour", DISPLAY_HOUR)),
                       visible=tuple(cfg.get("default_subreddit", DEFAULT_VISIBLE)))
