"""Fixed values of the data model: clock, periods, enums and windows."""

BLOCK_SECONDS = 30
BLOCKS_PER_DAY = 86400 // BLOCK_SECONDS

# Trailing periods in blocks, in display order.
PERIODS = {
    "24H": 2880,
    "7D": 20160,
    "30D": 86400,
    "90D": 259200,
    "6M": 518400,
}
SIX_MONTHS = PERIODS["6M"]
SIX_MONTH_DAYS = 180

# Enums stored in the tables.
BUYING, SELLING, P2P = "buying", "selling", "p2p"
EXCHANGE, FOUNDATION, NODE_OPERATOR, UNKNOWN = (
    "exchange",
    "foundation",
    "node_operator",
    "unknown",
)
COUNTERPARTY_TYPES = (NODE_OPERATOR, UNKNOWN, FOUNDATION)
SENT, RECEIVED = "sent", "received"
SYNC, ENHANCED = "sync", "enhanced"
TRANSFER, COINBASE = "transfer", "coinbase"

# Node tiers that every operator reports, zero when it has none.
TIERS = ("CUMULUS", "NIMBUS", "STRATUS")
DEFAULT_TIER = "CUMULUS"

# Attribution limits.
EVIDENCE_WINDOW = 87600
RETRY_HOURS = 24
DEFAULT_DEPTH = 2
MIN_CANDIDATES = 1

# Width, in heights, of the storage partitions (7 days of blocks).
BUCKET_BLOCKS = 20160

SATOSHI = 100_000_000


def period_blocks(period: str) -> int:
    """Blocks in a period, in any letter case; unknown names are an error."""
    try:
        return PERIODS[period.upper()]
    except KeyError:
        raise ValueError(f"unknown period {period!r}; use one of {list(PERIODS)}") from None
