"""What each registered query must return, as SQL for DuckDB over the same tables.

The SQL follows the definitions directly (row numbers, range joins, one step after
the other) and shares no shape with the Spark plans.
"""

from __future__ import annotations

PERIODS = {"24H": 2880, "7D": 20160, "30D": 86400, "90D": 259200, "6M": 518400}
NOW = 1_700_000_000

LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
)

# The ledger, its labels and its events, from the raw tables.
LEDGER = f"""
cnt AS (SELECT count(*) AS n FROM customer),
tx AS (
  SELECT 'T' || o_orderkey AS txid, o_orderkey AS tx_index,
         CAST(floor(epoch(o_orderdate) / 30) AS BIGINT) AS height,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS block_time,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 < 5 THEN 'coinbase'
              WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 5 THEN 'confirm'
              ELSE 'transfer' END AS kind,
         o_custkey, o_totalprice
  FROM orders),
inp AS (
  SELECT txid, kind, height, block_time, tx_index, 0 AS pos, 'W' || o_custkey AS address,
         CAST(round(o_totalprice * 1e8) AS BIGINT) AS sat
  FROM tx WHERE kind <> 'coinbase'
  UNION ALL
  SELECT txid, kind, height, block_time, tx_index, 1, 'W' || ((o_custkey + 1) % n), 0
  FROM tx, cnt WHERE kind <> 'coinbase' AND tx_index % 7 = 0),
outp AS (
  SELECT txid, kind, height, block_time, tx_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS vout,
         'W' || ((l_partkey * 7 + l_suppkey) % n) AS address,
         CAST(round(l_extendedprice * 1e8) AS BIGINT) AS sat
  FROM lineitem JOIN tx ON l_orderkey = tx_index, cnt),
listed AS (
  SELECT 'W' || c_custkey AS address,
         CASE WHEN c_custkey % 25 < 4 THEN 'exchange' ELSE 'foundation' END AS type,
         CASE WHEN c_custkey % 25 = 0 THEN 'EX_A' WHEN c_custkey % 25 = 1 THEN 'EX_B'
              WHEN c_custkey % 25 < 4 THEN 'EX_C' ELSE 'Foundation' END AS name
  FROM customer WHERE c_custkey % 25 < 6),
nodes AS (
  SELECT 'W' || c_custkey AS address,
         CASE WHEN c_custkey % 10 < 6 THEN 'CUMULUS' WHEN c_custkey % 10 < 9 THEN 'NIMBUS'
              ELSE 'STRATUS' END AS tier,
         CASE WHEN c_custkey % 10 < 6 THEN 1000.0 WHEN c_custkey % 10 < 9 THEN 12500.0
              ELSE 40000.0 END AS collateral,
         unnest(range(1 + c_custkey % 3)) AS copy
  FROM customer WHERE c_mktsegment = 'MACHINERY'),
ops AS (
  SELECT address, count(*) AS node_count,
         count(*) FILTER (WHERE tier = 'CUMULUS') || '/' || count(*) FILTER (WHERE tier = 'NIMBUS')
           || '/' || count(*) FILTER (WHERE tier = 'STRATUS') AS tiers,
         count(*) FILTER (WHERE tier = 'CUMULUS') AS cumulus,
         count(*) FILTER (WHERE tier = 'NIMBUS') AS nimbus,
         count(*) FILTER (WHERE tier = 'STRATUS') AS stratus,
         CAST(sum(collateral) AS DOUBLE) AS total_collateral
  FROM nodes GROUP BY address),
lab AS (
  SELECT address, type, name, NULL::BIGINT AS node_count, NULL::VARCHAR AS tiers,
         NULL::BIGINT AS cumulus, NULL::BIGINT AS nimbus, NULL::BIGINT AS stratus FROM listed
  UNION ALL
  SELECT address, 'node_operator', NULL, node_count, tiers, cumulus, nimbus, stratus
  FROM ops WHERE address NOT IN (SELECT address FROM listed)),
rel AS (
  SELECT txid FROM inp JOIN lab USING (address) WHERE kind = 'transfer'
  UNION
  SELECT txid FROM outp JOIN lab USING (address) WHERE kind = 'transfer'),
prim AS (
  SELECT txid, address AS from_address, coalesce(type, 'unknown') AS from_type, name AS from_name,
         node_count AS from_nodes, tiers AS from_tiers, cumulus AS from_cumulus,
         nimbus AS from_nimbus, stratus AS from_stratus
  FROM (SELECT i.txid, i.address, l.*EXCLUDE (address), row_number() OVER (
          PARTITION BY i.txid
          ORDER BY CASE l.type WHEN 'exchange' THEN 0 WHEN 'node_operator' THEN 1
                               WHEN 'foundation' THEN 2 ELSE 3 END, i.pos) AS rn
        FROM inp i LEFT JOIN lab l ON i.address = l.address
        WHERE i.kind = 'transfer' AND i.txid IN (SELECT txid FROM rel))
  WHERE rn = 1),
ev AS (
  SELECT o.txid, o.vout, o.height AS block_height, o.block_time,
         o.tx_index * 1048576 + o.vout AS event_seq,
         p.*EXCLUDE (txid),
         o.address AS to_address, coalesce(l.type, 'unknown') AS to_type, l.name AS to_name,
         l.node_count AS to_nodes, l.tiers AS to_tiers, l.cumulus AS to_cumulus,
         l.nimbus AS to_nimbus, l.stratus AS to_stratus,
         CASE WHEN l.type = 'exchange' AND p.from_type <> 'exchange' THEN 'selling'
              WHEN p.from_type = 'exchange' AND coalesce(l.type, '') <> 'exchange' THEN 'buying'
              ELSE 'p2p' END AS flow_type,
         o.sat
  FROM outp o JOIN prim p USING (txid) LEFT JOIN lab l ON o.address = l.address
  WHERE o.kind = 'transfer'),
tip AS (SELECT max(height) AS tip FROM tx),
ev_blocks AS (
  SELECT CAST(floor(epoch(ts) / 30) AS BIGINT) AS height, count(*) AS tx_count
  FROM events GROUP BY 1)
"""

# Wallet histories and the open events to be attributed.
HISTORY = """
hist AS (
  SELECT wallet, txid, height, block_time, tx_index,
         CASE WHEN max(sent) = 1 THEN 'sent' ELSE 'received' END AS direction,
         bool_or(is_coinbase) AS is_coinbase
  FROM (SELECT address AS wallet, txid, height, block_time, tx_index, 1 AS sent, FALSE AS is_coinbase
        FROM inp WHERE kind = 'transfer'
        UNION ALL
        SELECT address, txid, height, block_time, tx_index, 0, kind = 'coinbase'
        FROM outp WHERE kind IN ('transfer', 'coinbase'))
  GROUP BY wallet, txid, height, block_time, tx_index),
receipts AS (SELECT wallet, height FROM hist WHERE is_coinbase),
open_ev AS (
  SELECT 'buying' AS side, to_address AS wallet, * FROM ev
  WHERE flow_type = 'buying' AND to_type = 'unknown'
  UNION ALL
  SELECT 'selling', from_address, * FROM ev
  WHERE flow_type = 'selling' AND from_type = 'unknown'),
cand AS (
  SELECT * FROM open_ev)
"""


def evidence(asked: str) -> str:
    """Coinbase evidence for (wallet, height) pairs of the CTE ``asked``."""
    return f"""
  SELECT a.wallet, a.height, count(*) AS coinbase_count, max(r.height) AS last_block,
         min(r.height) AS first_block,
         CAST(floor((a.height - max(r.height)) * 30 / 86400) AS BIGINT) AS days_inactive
  FROM (SELECT DISTINCT wallet, height FROM {asked}) a
  JOIN receipts r ON r.wallet = a.wallet AND r.height BETWEEN a.height - 87600 AND a.height
  GROUP BY a.wallet, a.height"""


def connection(asked: str, name: str) -> str:
    """CTEs that end in ``name``: the historical connection of each probe of ``asked``."""
    return f"""
{name}_recent AS (
  SELECT a.side, a.wallet, a.height, h.txid, h.height AS tx_height,
         row_number() OVER (PARTITION BY a.side, a.wallet, a.height
                            ORDER BY h.height DESC, h.tx_index DESC) AS tx_rank
  FROM (SELECT DISTINCT side, wallet, height FROM {asked}) a
  JOIN hist h ON h.wallet = a.wallet AND NOT h.is_coinbase
   AND h.direction = CASE a.side WHEN 'buying' THEN 'sent' ELSE 'received' END
   AND h.height BETWEEN a.height - 87600 AND a.height),
{name}_party AS (
  SELECT 'buying' AS side, txid, address, vout AS pos FROM outp WHERE kind = 'transfer'
  UNION ALL
  SELECT 'selling', txid, address, pos FROM inp WHERE kind = 'transfer'),
{name}_met AS (
  SELECT r.side, r.wallet AS probe, r.height, r.txid, r.tx_height, r.tx_rank, p.pos,
         p.address AS wallet, o.address IS NOT NULL AS is_operator
  FROM {name}_recent r JOIN {name}_party p ON p.txid = r.txid AND p.side = r.side
  LEFT JOIN ops o ON o.address = p.address),
{name}_proof AS ({evidence(name + '_met')}),
{name} AS (
  SELECT m.side, m.probe AS wallet, m.height,
         CASE WHEN is_operator THEN 'current_node_operator' ELSE 'historical_node_operator' END AS method,
         m.wallet AS node_wallet, m.txid AS connection_txid, m.tx_height AS connection_block,
         CAST(floor((m.height - m.tx_height) * 30 / 86400) AS BIGINT) AS days_ago,
         CASE WHEN NOT is_operator THEN p.coinbase_count END AS coinbase_count,
         CASE WHEN NOT is_operator THEN p.last_block END AS coinbase_last_block
  FROM {name}_met m LEFT JOIN {name}_proof p ON p.wallet = m.wallet AND p.height = m.height
  WHERE is_operator OR p.wallet IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY m.side, m.probe, m.height ORDER BY m.tx_rank, m.pos) = 1)"""


def hop(asked: str, order: str = "DESC") -> str:
    """The hop of each (side, wallet, height, block_time) of ``asked``."""
    return f"""
  SELECT * FROM (
    SELECT a.side, a.wallet, a.height, o.address AS next_wallet, h.txid AS hop_txid,
           h.height AS hop_height,
           row_number() OVER (PARTITION BY a.side, a.wallet, a.height
                              ORDER BY h.height {order}, h.tx_index {order}, o.vout) AS rn
    FROM (SELECT DISTINCT side, wallet, height, block_time FROM {asked} WHERE side = 'buying') a
    JOIN hist h ON h.wallet = a.wallet AND h.direction = 'sent'
     AND h.height > a.height AND h.block_time > a.block_time
    JOIN outp o ON o.txid = h.txid AND o.address <> a.wallet
    UNION ALL
    SELECT a.side, a.wallet, a.height, i.address, h.txid, h.height,
           row_number() OVER (PARTITION BY a.side, a.wallet, a.height
                              ORDER BY h.height DESC, h.tx_index DESC, i.pos) AS rn
    FROM (SELECT DISTINCT side, wallet, height, block_time FROM {asked} WHERE side = 'selling') a
    JOIN hist h ON h.wallet = a.wallet AND h.direction = 'received'
     AND h.height < a.height AND h.block_time < a.block_time
    JOIN inp i ON i.txid = h.txid AND i.address <> a.wallet)
  WHERE rn = 1"""


def two_hops(asked: str, name: str) -> str:
    """CTEs that end in ``name``: the outcome of at most two hops from each probe."""
    return f"""
{name}_h1 AS ({hop(asked)}),
{name}_ask1 AS (SELECT next_wallet AS wallet, height FROM {name}_h1),
{name}_proof1 AS ({evidence(name + '_ask1')}),
{name}_s1 AS (
  SELECT a.side, a.wallet, a.height, a.block_time, h.next_wallet, h.hop_txid,
         CASE WHEN h.next_wallet = a.wallet THEN NULL
              WHEN o.address IS NOT NULL THEN 'current_api'
              WHEN p.wallet IS NOT NULL THEN 'historical_coinbase' END AS method,
         p.coinbase_count, p.last_block, p.days_inactive
  FROM (SELECT DISTINCT side, wallet, height, block_time FROM {asked}) a
  LEFT JOIN {name}_h1 h ON h.side = a.side AND h.wallet = a.wallet AND h.height = a.height
  LEFT JOIN ops o ON o.address = h.next_wallet
  LEFT JOIN {name}_proof1 p ON p.wallet = h.next_wallet AND p.height = a.height),
{name}_next AS (
  SELECT side, next_wallet AS wallet, height, block_time FROM {name}_s1
  WHERE method IS NULL AND next_wallet IS NOT NULL),
{name}_h2 AS ({hop(name + '_next')}),
{name}_ask2 AS (SELECT next_wallet AS wallet, height FROM {name}_h2),
{name}_proof2 AS ({evidence(name + '_ask2')}),
{name}_s2 AS (
  SELECT s.side, s.wallet, s.height, s.next_wallet AS middle, s.hop_txid AS txid1,
         h.next_wallet, h.hop_txid AS txid2,
         coalesce(h.next_wallet IN (s.wallet, s.next_wallet), FALSE) AS cycle,
         CASE WHEN h.next_wallet IN (s.wallet, s.next_wallet) THEN NULL
              WHEN o.address IS NOT NULL THEN 'current_api'
              WHEN p.wallet IS NOT NULL THEN 'historical_coinbase' END AS method,
         p.coinbase_count, p.last_block, p.days_inactive
  FROM {name}_s1 s
  LEFT JOIN {name}_h2 h ON h.side = s.side AND h.wallet = s.next_wallet AND h.height = s.height
  LEFT JOIN ops o ON o.address = h.next_wallet
  LEFT JOIN {name}_proof2 p ON p.wallet = h.next_wallet AND p.height = s.height
  WHERE s.method IS NULL),
{name} AS (
  SELECT side, wallet, height, 1 AS level, wallet AS chain, next_wallet AS node_wallet,
         hop_txid AS txids, method,
         CASE method WHEN 'current_api' THEN 'active' ELSE 'historical' END AS status,
         CASE method WHEN 'historical_coinbase' THEN coinbase_count END AS coinbase_count,
         CASE method WHEN 'historical_coinbase' THEN last_block END AS last_block,
         CASE method WHEN 'historical_coinbase' THEN days_inactive END AS days_inactive,
         FALSE AS cycle
  FROM {name}_s1 WHERE method IS NOT NULL
  UNION ALL
  SELECT side, wallet, height,
         CASE WHEN method IS NOT NULL THEN 2 END,
         CASE WHEN method IS NOT NULL THEN wallet || ',' || middle END,
         CASE WHEN method IS NOT NULL THEN next_wallet END,
         CASE WHEN method IS NOT NULL THEN txid1 || ',' || txid2 END,
         method,
         CASE method WHEN 'current_api' THEN 'active' WHEN 'historical_coinbase' THEN 'historical' END,
         CASE method WHEN 'historical_coinbase' THEN coinbase_count END,
         CASE method WHEN 'historical_coinbase' THEN last_block END,
         CASE method WHEN 'historical_coinbase' THEN days_inactive END,
         cycle
  FROM {name}_s2)"""


# The whole attribution run over all candidates.
RUN = f"""
probe0 AS (SELECT DISTINCT side, wallet, block_height AS height, block_time FROM cand),
l0 AS ({evidence('probe0')}),
probe1 AS (SELECT * FROM probe0 p WHERE NOT EXISTS (
  SELECT 1 FROM l0 WHERE l0.wallet = p.wallet AND l0.height = p.height)),
{connection('probe1', 'conn')},
probe2 AS (SELECT * FROM probe1 p WHERE NOT EXISTS (
  SELECT 1 FROM conn c WHERE c.side = p.side AND c.wallet = p.wallet AND c.height = p.height)),
{two_hops('probe2', 'hops')},
answer AS (
  SELECT p.side, p.wallet, p.height, 'historical_coinbase' AS method, 'historical' AS status,
         0 AS level, NULL AS chain, p.wallet AS node_wallet, NULL AS txids,
         l0.coinbase_count, l0.last_block, l0.days_inactive,
         NULL AS connection_txid, NULL::BIGINT AS connection_block, NULL::BIGINT AS days_ago,
         NULL::BIGINT AS destination_coinbase_count, NULL::BIGINT AS destination_last_coinbase,
         FALSE AS cycle
  FROM probe0 p JOIN l0 ON l0.wallet = p.wallet AND l0.height = p.height
  UNION ALL
  SELECT side, wallet, height, 'historical_connection',
         CASE method WHEN 'current_node_operator' THEN 'active' ELSE 'historical' END,
         0, NULL, node_wallet, NULL, NULL, NULL, NULL, connection_txid, connection_block, days_ago,
         coinbase_count, coinbase_last_block, FALSE
  FROM conn
  UNION ALL
  SELECT side, wallet, height, method, status, level, chain, node_wallet, txids,
         coinbase_count, last_block, days_inactive, NULL, NULL, NULL, NULL, NULL, cycle
  FROM hops),
run AS (
  SELECT c.side, c.txid, c.vout, a.*EXCLUDE (side, wallet, height),
         CASE WHEN NOT (a.method = 'historical_coinbase' AND a.level = 0) THEN o.node_count END AS op_nodes,
         CASE WHEN NOT (a.method = 'historical_coinbase' AND a.level = 0) THEN o.tiers END AS op_tiers
  FROM cand c
  JOIN answer a ON a.side = c.side AND a.wallet = c.wallet AND a.height = c.block_height
  LEFT JOIN ops o ON o.address = a.node_wallet)
"""

# Events after the run.
ENRICHED_FIELDS = {
    "node_wallet": "r.node_wallet",
    "hop_count": "r.level",
    "detection_method": "r.method",
    "status": "r.status",
    "last_coinbase_block": "r.last_block",
    "coinbase_count": "r.coinbase_count",
    "days_inactive": "r.days_inactive",
    "connection_txid": "r.connection_txid",
    "connection_block": "r.connection_block",
    "days_ago": "r.days_ago",
    "destination_coinbase_count": "r.destination_coinbase_count",
    "destination_last_coinbase": "r.destination_last_coinbase",
    "txids": "r.txids",
}


def _enriched_side(prefix: str, side: str) -> str:
    mine = f"r.method IS NOT NULL AND r.side = '{side}'"
    columns = [
        f"CASE WHEN {mine} THEN 'node_operator' ELSE e.{prefix}_type END AS {prefix}_type",
        f"CASE WHEN {mine} THEN NULL ELSE e.{prefix}_name END AS {prefix}_name",
        f"CASE WHEN {mine} THEN r.op_nodes ELSE e.{prefix}_nodes END AS {prefix}_node_count",
        f"CASE WHEN {mine} THEN r.op_tiers ELSE e.{prefix}_tiers END AS {prefix}_tiers",
    ]
    columns += [f"CASE WHEN {mine} THEN {x} END AS {prefix}_{name}" for name, x in ENRICHED_FIELDS.items()]
    return ",\n         ".join(columns)


ENRICHED = f"""
enriched AS (
  SELECT e.txid, e.vout, e.block_height, e.from_address, e.to_address, e.flow_type,
         CASE WHEN r.method IS NOT NULL THEN r.level ELSE 0 END AS classification_level,
         CASE WHEN r.level > 0 THEN split_part(r.chain, ',', 1) END AS intermediary_wallet,
         CASE WHEN r.level > 0 THEN r.chain END AS hop_chain,
         CASE WHEN r.txid IS NOT NULL THEN CAST({NOW} AS BIGINT) END AS analysis_timestamp,
         CASE WHEN r.method IS NOT NULL THEN 'enhanced' ELSE 'sync' END AS data_source,
         {_enriched_side('from', 'selling')},
         {_enriched_side('to', 'buying')}
  FROM ev e LEFT JOIN run r ON r.txid = e.txid AND r.vout = e.vout)
"""

# The transaction-level view.
TX_VIEW = """
party AS (
  SELECT txid, 'from' AS direction, pos, address FROM inp WHERE kind = 'transfer'
  UNION ALL
  SELECT txid, 'to', vout, address FROM outp WHERE kind = 'transfer'),
cls AS (
  SELECT p.*, coalesce(l.type, 'unknown') AS type, l.name, l.node_count AS nodes
  FROM party p LEFT JOIN lab l USING (address)),
tx_value AS (SELECT txid, sum(sat) AS sat FROM outp GROUP BY txid),
txv AS (
  SELECT t.txid, t.height AS block_height, t.block_time, t.tx_index,
         coalesce(v.sat, 0) AS sat,
         CASE WHEN x.ex_to AND NOT x.ex_from THEN 'sell' WHEN x.ex_from AND NOT x.ex_to THEN 'buy'
              WHEN x.ex_from AND x.ex_to THEN 'transfer' END AS flow_type
  FROM tx t LEFT JOIN tx_value v USING (txid)
  LEFT JOIN (SELECT txid, bool_or(direction = 'from' AND type = 'exchange') AS ex_from,
                    bool_or(direction = 'to' AND type = 'exchange') AS ex_to
             FROM cls GROUP BY txid) x USING (txid)
  WHERE t.kind = 'transfer')
"""



def coins(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE) / 1e8"


def ledger(select: str, *more: str) -> str:
    return "WITH " + ",".join([LEDGER, *more]) + select


def in_period(period: str) -> str:
    return (
        f"block_height BETWEEN (SELECT tip FROM tip) - {PERIODS[period]} AND (SELECT tip FROM tip)"
    )


PERIOD_ROWS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in PERIODS.items()) + ") AS p(period, blocks)"

EVENT_COLUMNS = f"""txid, vout, block_height, block_time, event_seq,
  from_address, from_type, from_name, from_nodes, from_tiers,
  to_address, to_type, to_name, to_nodes, to_tiers,
  flow_type, {coins('sat')} AS amount, 0 AS classification_level, 'sync' AS data_source"""


def top_parties(prefix: str, side: str, total: str) -> str:
    other = "from" if prefix == "to" else "to"
    return ledger(f"""
SELECT {prefix}_address AS address,
       arg_max({prefix}_type, block_height * 100000000000::HUGEINT * 1048576 + event_seq) AS type,
       {coins('sum(sat)')} AS {total}, count(*) AS event_count,
       array_to_string(list_sort(list_distinct(list({other}_name))), ',') AS exchanges
FROM ev WHERE flow_type = '{side}' AND {in_period('6M')}
GROUP BY 1
ORDER BY sum(sat) DESC, max(block_height * 100000000000::HUGEINT * 1048576 + event_seq) DESC, 1 LIMIT 10""")


def all_period_sides(select: str) -> str:
    return ledger(f"""
SELECT {select} FROM (
  SELECT p.period, {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'buying'), 0)")} AS buying,
         {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'selling'), 0)")} AS selling,
         {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'p2p'), 0)")} AS p2p
  FROM {PERIOD_ROWS} LEFT JOIN ev
    ON block_height BETWEEN (SELECT tip FROM tip) - p.blocks AND (SELECT tip FROM tip)
  GROUP BY p.period)""")


SIDES = """(VALUES ('buying', 'node_operator', 'toNodeOperators', 'To Node Operators'),
 ('buying', 'unknown', 'toUnknown', 'To Unknown Wallets'),
 ('buying', 'foundation', 'toFoundation', 'To Foundation'),
 ('selling', 'node_operator', 'fromNodeOperators', 'From Node Operators'),
 ('selling', 'unknown', 'fromUnknown', 'From Unknown Wallets'),
 ('selling', 'foundation', 'fromFoundation', 'From Foundation')) AS c(flow_type, party_type, category, label)"""


def per_party(period: str) -> str:
    return f"""(SELECT flow_type, CASE flow_type WHEN 'buying' THEN to_type ELSE from_type END AS party_type,
  sum(sat) AS sat, count(*) AS events FROM ev
  WHERE flow_type IN ('buying', 'selling') AND {in_period(period)} GROUP BY 1, 2)"""


def tx_top(kind: str, direction: str, total: str) -> str:
    return ledger(f"""
SELECT address, min(type) AS type, count(DISTINCT txid) AS transaction_count, {coins('sum(sat)')} AS {total}
FROM txv JOIN cls USING (txid)
WHERE flow_type = '{kind}' AND direction = '{direction}' AND type <> 'exchange'
GROUP BY address ORDER BY sum(sat) DESC, address LIMIT 10""", TX_VIEW)


def detail_view(side: str, wallet: str, exchange: str) -> str:
    return f"""
SELECT txid, vout, block_height,
       CASE WHEN length(txid) > 0 THEN left(txid, 8) || '...' || right(txid, 6) ELSE '' END AS short_txid,
       coalesce({exchange}_name, 'Unknown Exchange') AS exchange,
       CASE WHEN {exchange}_name IS NOT NULL THEN '/logos/' || lower({exchange}_name) || '.png' END AS logo,
       {wallet}_address AS wallet,
       left({wallet}_address, 8) || '...' || right({wallet}_address, 6) AS short_wallet,
       {wallet}_type AS wallet_type,
       CASE {wallet}_type WHEN 'node_operator' THEN 'Node Operator' WHEN 'exchange' THEN 'Exchange'
         WHEN 'foundation' THEN 'Foundation' ELSE 'Unknown Wallet' END AS wallet_label,
       coalesce({wallet}_nodes, 0) AS node_count, coalesce({wallet}_cumulus, 0) AS cumulus,
       coalesce({wallet}_nimbus, 0) AS nimbus, coalesce({wallet}_stratus, 0) AS stratus,
       {coins('sat')} AS amount, '{side}' AS side
FROM ev WHERE flow_type = '{side}'"""


def badge_view(side: str, wallet: str) -> str:
    method = f"coalesce({wallet}_detection_method, 'current_api')"
    historical = f"{method} IN ('historical_connection', 'historical_coinbase')"
    enhanced = "(classification_level > 0 OR data_source = 'enhanced')"
    return f"""
SELECT txid, vout, classification_level AS level, {enhanced} AS is_enhanced, hop_chain,
       CASE WHEN classification_level > 0 AND hop_chain IS NOT NULL
            THEN coalesce({wallet}_node_wallet, {wallet}_address) ELSE {wallet}_node_wallet END AS node_wallet,
       {method} AS method, coalesce({wallet}_status, 'active') AS status,
       CASE WHEN classification_level = 0 AND {historical} THEN 'historical'
            WHEN classification_level > 0 AND hop_chain IS NOT NULL THEN 'multi-hop'
            ELSE 'direct' END AS hierarchy,
       CASE WHEN {historical} THEN {wallet}_coinbase_count END AS coinbase_count,
       CASE WHEN {historical} THEN {wallet}_days_inactive END AS days_inactive,
       CASE WHEN {historical} THEN {wallet}_connection_txid END AS connection_txid,
       CASE WHEN {historical} THEN {wallet}_days_ago END AS days_ago,
       CASE WHEN {enhanced} THEN 'L' || classification_level END AS badge,
       CASE WHEN {enhanced} THEN 'Level ' || classification_level || ' Detection' END AS badge_title,
       CASE WHEN {enhanced} THEN CASE {method}
              WHEN 'historical_coinbase' THEN 'Historical node operator (coinbase detected)'
              WHEN 'historical_connection' THEN 'Historical connection to node operator'
              ELSE 'Active node operator' END
            || CASE WHEN classification_level = 0 THEN ' (direct)'
                    ELSE ' (' || classification_level || '-hop)' END END AS badge_text,
       '{side}' AS side
FROM enriched WHERE flow_type = '{side}'"""


ALL_PROBES = "probe AS (SELECT DISTINCT side, wallet, block_height AS height, block_time FROM open_ev)"
EVENTS = ledger(f"SELECT {EVENT_COLUMNS} FROM ev")

ORACLES: dict[str, str] = {
    # events
    "flow_events": EVENTS,
    "classify_addresses": ledger("""
SELECT txid, vout, o.address, coalesce(type, 'unknown') AS type, name, node_count AS nodes
FROM outp o LEFT JOIN lab l ON o.address = l.address"""),
    "primary_input": ledger("SELECT txid, from_address, from_type, from_name FROM prim"),
    "relevant_transactions": ledger(
        "SELECT txid, kind, height, block_time, tx_index FROM tx WHERE txid IN (SELECT txid FROM rel)"
    ),
    "cap_per_block": ledger("""
SELECT txid, height, tx_index FROM tx WHERE kind = 'transfer'
QUALIFY row_number() OVER (PARTITION BY height ORDER BY tx_index) <= 3"""),
    "relevance_rate": ledger("""
SELECT height, coalesce(r.relevant, 0) AS relevant, total, coalesce(r.relevant, 0) / total AS rate
FROM (SELECT height, count(*) AS total FROM tx GROUP BY height)
LEFT JOIN (SELECT block_height AS height, count(DISTINCT txid) AS relevant FROM ev GROUP BY 1) r USING (height)"""),
    "tx_totals": ledger(f"""
SELECT t.txid, t.height AS block_height, t.block_time,
       coalesce(i.n, 0) AS input_count, coalesce(o.n, 0) AS output_count,
       {coins('coalesce(i.sat, 0)')} AS total_input_value, {coins('coalesce(o.sat, 0)')} AS total_output_value
FROM tx t
LEFT JOIN (SELECT txid, count(*) AS n, sum(sat) AS sat FROM inp GROUP BY txid) i USING (txid)
LEFT JOIN (SELECT txid, count(*) AS n, sum(sat) AS sat FROM outp GROUP BY txid) o USING (txid)"""),
    "flow_events_between": ledger(
        f"SELECT {EVENT_COLUMNS} FROM ev WHERE block_height BETWEEN 28000000 AND 29000000"
    ),
    "drill_down_buying_unknown": ledger(f"""
SELECT txid, vout, block_height, from_address, to_address, {coins('sat')} AS amount
FROM ev WHERE flow_type = 'buying' AND to_type = 'unknown'"""),
    # periods
    "flow_summary_90d": ledger(f"""
SELECT flow_type, {coins('coalesce(sum(sat), 0)')} AS total, count(sat) AS events
FROM (VALUES ('buying'), ('selling'), ('p2p')) AS f(flow_type)
LEFT JOIN (SELECT * FROM ev WHERE {in_period('90D')}) USING (flow_type) GROUP BY flow_type"""),
    "flow_breakdown_90d": ledger(f"""
SELECT flow_type, party_type, {coins('coalesce(sat, 0)')} AS total, coalesce(events, 0) AS events
FROM {SIDES} LEFT JOIN {per_party('90D')} USING (flow_type, party_type)"""),
    "by_exchange_90d": ledger(f"""
SELECT flow_type, CASE flow_type WHEN 'buying' THEN from_name ELSE to_name END AS exchange,
       {coins('sum(sat)')} AS total, count(*) AS events
FROM ev WHERE flow_type IN ('buying', 'selling') AND {in_period('90D')} GROUP BY 1, 2"""),
    "net_flow_30d": ledger(f"""
SELECT buying, selling, buying - selling AS net_flow FROM (
  SELECT {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'buying'), 0)")} AS buying,
         {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'selling'), 0)")} AS selling
  FROM ev WHERE {in_period('30D')})"""),
    "net_flow_all_periods": all_period_sides("period, buying, selling, p2p, buying - selling AS net_flow"),
    "event_range_90d": ledger(f"""
SELECT coalesce(max(block_height), 0) AS newest, coalesce(min(block_height), 0) AS oldest, count(*) AS events
FROM ev WHERE {in_period('90D')}"""),
    "top_buyers_6m": top_parties("to", "buying", "total_bought"),
    "top_sellers_6m": top_parties("from", "selling", "total_sold"),
    "sentiment_all_periods": all_period_sides(
        "period, buying, selling, CASE WHEN buying > selling THEN 'Bullish' ELSE 'Bearish' END AS sentiment, "
        "abs(buying - selling) AS difference"
    ),
    "category_series_6m": ledger(f"""
, side AS (SELECT flow_type, sum(sat) AS side_sat FROM {per_party('6M')} GROUP BY 1)
SELECT flow_type, category, label, {coins('coalesce(sat, 0)')} AS value, coalesce(events, 0) AS events,
       CASE WHEN coalesce(side_sat, 0) > 0
            THEN {coins('coalesce(sat, 0)')} / ({coins('side_sat')}) * 100 ELSE 0 END AS percentage,
       CASE WHEN coalesce(side_sat, 0) > 0
            THEN {coins('side_sat')} / ({coins('(SELECT max(side_sat) FROM side)')}) * 100 ELSE 0 END AS bar_height
FROM {SIDES} LEFT JOIN {per_party('6M')} USING (flow_type, party_type) LEFT JOIN side USING (flow_type)"""),
    "flow_type_stats": ledger(f"""
SELECT flow_type, count(*) AS events, {coins('sum(sat)')} AS total_amount FROM ev GROUP BY 1"""),
    # registry, coverage
    "node_operators": ledger("SELECT address, node_count, tiers, total_collateral FROM ops"),
    "label_stats": ledger("""
SELECT (SELECT count(*) FROM listed WHERE type = 'exchange') AS exchange_count,
       (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT DISTINCT name FROM listed WHERE type = 'exchange'))
         AS exchange_names,
       (SELECT count(*) FROM listed WHERE type = 'foundation') AS foundation_count,
       count(*) AS operator_count, CAST(sum(node_count) AS BIGINT) AS total_nodes,
       CAST(sum(cumulus) AS BIGINT) AS cumulus_nodes, CAST(sum(nimbus) AS BIGINT) AS nimbus_nodes,
       CAST(sum(stratus) AS BIGINT) AS stratus_nodes
FROM ops"""),
    "top_node_operators": ledger(
        "SELECT address, node_count, tiers FROM ops ORDER BY node_count DESC, address LIMIT 10"
    ),
    "ledger_counts": ledger("""
SELECT (SELECT count(DISTINCT height) FROM tx) AS blocks, (SELECT count(*) FROM rel) AS transactions,
       (SELECT count(*) FROM ev) AS flow_events, (SELECT max(height) FROM tx) AS latest_height"""),
    "coverage_stats": ledger("""
SELECT count(*) AS blocks, min(height) AS min_height, max(height) AS max_height,
       max(height) - min(height) AS span, round((max(height) - min(height)) / 518400 * 180, 1) AS age_days,
       round(count(*) / 518400 * 100, 1) AS percent_of_target
FROM ev_blocks"""),
    "block_gaps": ledger("""
SELECT height + 1 AS from_height, nxt - 1 AS to_height, nxt - height - 1 AS missing
FROM (SELECT height, lead(height) OVER (ORDER BY height) AS nxt FROM ev_blocks) WHERE nxt > height + 1"""),
    "period_readiness": ledger(f"""
SELECT period, n > 0 AND n >= blocks AS ready, n > 0 AND n < blocks AS partial,
       round(n / blocks * 100, 1) AS progress, CAST(blocks AS BIGINT) AS blocks_needed, n AS blocks_synced,
       least(100.0::DOUBLE, n / 518400 * 100) AS sync_progress
FROM {PERIOD_ROWS}, (SELECT count(*) AS n FROM ev_blocks)"""),
    "block_times": ledger("""
SELECT height,
       CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h'
            WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
            ELSE (s // 60) || 'm' END AS age_text,
       s // 86400 AS age_days,
       CAST(floor(tx_count * 1.5 * 3600 / 30) AS BIGINT) AS blocks_of_hours,
       CASE WHEN b < 1024 THEN b || ' B'
            WHEN b < 1048576 THEN printf('%.2f', b / 1024) || ' KB'
            WHEN b < 1073741824 THEN printf('%.2f', b / 1048576) || ' MB'
            ELSE printf('%.2f', b / 1073741824) || ' GB' END AS size_text
FROM (SELECT height, tx_count, age * 30 AS s, tx_count * age * age AS b
      FROM (SELECT *, (SELECT max(height) FROM ev_blocks) - height AS age FROM ev_blocks))"""),
    # attribution
    "wallet_history": ledger(
        "SELECT wallet, txid, height, block_time, tx_index, direction, is_coinbase FROM hist", HISTORY
    ),
    "attribution_candidates": ledger(f"""
SELECT side, txid, vout, wallet, block_height AS height, block_time, from_address, to_address,
       {coins('sat')} AS amount, 0 AS classification_level FROM cand""", HISTORY),
    "unknown_stats": ledger("""
SELECT b AS unknown_buys, s AS unknown_sells, b + s AS total_unknowns
FROM (SELECT count(*) FILTER (WHERE side = 'buying') AS b, count(*) FILTER (WHERE side = 'selling') AS s
      FROM open_ev)""", HISTORY),
    "coinbase_evidence": ledger(evidence("probe"), HISTORY, ALL_PROBES),
    "historical_connection": ledger(" SELECT * FROM conn", HISTORY, ALL_PROBES, connection("probe", "conn")),
    "next_hop": ledger(f"""
SELECT wallet, height, next_wallet, hop_txid, hop_height FROM ({hop('probe')}) WHERE side = 'buying'""",
                       HISTORY, ALL_PROBES),
    "next_hop_oldest": ledger(f"""
SELECT wallet, height, next_wallet, hop_txid, hop_height FROM ({hop('probe', 'ASC')}) WHERE side = 'buying'""",
                              HISTORY, ALL_PROBES),
    "prev_hop": ledger(f"""
SELECT wallet, height, next_wallet, hop_txid, hop_height FROM ({hop('probe')}) WHERE side = 'selling'""",
                       HISTORY, ALL_PROBES),
    "multi_hop_2": ledger(" SELECT * FROM hops", HISTORY, ALL_PROBES, two_hops("probe", "hops")),
    "attributed_events": ledger(" SELECT * FROM enriched", HISTORY, RUN, ENRICHED),
    "attribution_cycle_stored": ledger(f"""
SELECT * REPLACE (CASE WHEN analysis_timestamp IS NULL THEN NULL WHEN block_height >= 1389 * 20160 THEN {NOW} + 3600
                       WHEN data_source = 'enhanced' THEN {NOW} ELSE {NOW} + 88000 END::BIGINT AS analysis_timestamp)
FROM enriched""", HISTORY, RUN, ENRICHED),
    "attribution_stats": ledger("""
SELECT classification_level, data_source, count(*) AS events FROM enriched
WHERE classification_level > 0 GROUP BY 1, 2""", HISTORY, RUN, ENRICHED),
    "attribution_report": ledger("""
SELECT side, coalesce(method, 'not_found') AS method, coalesce(level, 0) AS level, count(*) AS events,
       count(*) FILTER (WHERE cycle) AS cycles FROM run GROUP BY 1, 2, 3""", HISTORY, RUN),
    # tables
    "upsert_dedupe": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_shipdate DESC) = 1""",
    "retain_6m": ledger(
        "SELECT txid, height FROM tx WHERE height >= greatest((SELECT tip FROM tip) - 518400, 1)"
    ),
    "retention_report": ledger("""
, lowest AS (SELECT greatest(tip - 518400, 1) AS h FROM tip)
SELECT (SELECT count(DISTINCT height) FROM tx, lowest WHERE height < h) AS blocks,
       (SELECT count(*) FROM tx, lowest WHERE height < h AND txid IN (SELECT txid FROM rel)) AS transactions,
       (SELECT count(*) FROM ev, lowest WHERE block_height < h) AS flow_events"""),
    "retention_applied": ledger("""
, lowest AS (SELECT greatest(tip - 518400, 1) AS low FROM tip),
r AS (SELECT DISTINCT 'blocks' AS part, height AS h, 0::BIGINT AS n, '' AS k FROM tx
      UNION ALL SELECT 'transactions', height, 0, txid FROM tx WHERE txid IN (SELECT txid FROM rel)
      UNION ALL SELECT 'flow_events', block_height, vout, txid FROM ev),
w AS (SELECT part, h // 20160 AS week, max(h) < any_value(low) AS gone FROM r, lowest GROUP BY 1, 2)
SELECT part, count(*) AS rows_before, count(*) FILTER (WHERE h < low) AS rows_deleted, any_value(weeks) AS weeks_before,
       any_value(dropped) AS weeks_dropped, count(*) FILTER (WHERE h >= low) AS rows_left, min(h) FILTER (WHERE h >= low) AS lowest
FROM r CROSS JOIN lowest JOIN (SELECT part, count(*) AS weeks, count(*) FILTER (WHERE gone) AS dropped FROM w GROUP BY 1) USING (part) GROUP BY part"""),
    "retention_due": ledger("""
SELECT max(height) - min(height) AS span,
       max(height) - min(height) > 518400 * 1.1 AND max(height) >= 1000 AS due FROM tx"""),
    # views
    "event_detail_view": ledger(detail_view("buying", "to", "from") + " UNION ALL " + detail_view("selling", "from", "to")),
    "attribution_view": ledger(
        badge_view("buying", "to") + " UNION ALL " + badge_view("selling", "from"), HISTORY, RUN, ENRICHED
    ),
    # transaction view
    "classify_transactions": ledger(f"""
SELECT txid, block_height, block_time, tx_index, {coins('sat')} AS total_value, flow_type,
       CASE flow_type WHEN 'sell' THEN 'to_exchange' WHEN 'buy' THEN 'from_exchange'
                      WHEN 'transfer' THEN 'exchange_to_exchange' END AS flow_direction FROM txv""", TX_VIEW),
    "explode_classifications": ledger(
        " SELECT txid, direction, pos, address, type, name, nodes FROM cls", TX_VIEW
    ),
    "tx_with_parties": ledger(f"""
SELECT txid, block_height, flow_type, {coins('sat')} AS total_value, direction, pos, address, type
FROM txv LEFT JOIN cls USING (txid) WHERE flow_type IS NOT NULL""", TX_VIEW),
    "tx_flow_summary": ledger(f"""
SELECT flow_type, count(txid) AS tx_count, {coins('coalesce(sum(sat), 0)')} AS total_value
FROM (VALUES ('buy'), ('sell'), ('transfer')) AS f(flow_type) LEFT JOIN txv USING (flow_type)
GROUP BY flow_type""", TX_VIEW),
    "buying_transactions": ledger(f"""
SELECT txid, block_height, {coins('sat')} AS total_value FROM txv WHERE flow_type = 'buy'""", TX_VIEW),
    "selling_transactions": ledger(f"""
SELECT txid, block_height, {coins('sat')} AS total_value FROM txv WHERE flow_type = 'sell'""", TX_VIEW),
    "tx_between": ledger(f"""
SELECT txid, block_height, block_time, tx_index, {coins('sat')} AS total_value, flow_type
FROM txv WHERE block_height BETWEEN 28000000 AND 29000000""", TX_VIEW),
    "lookup_transaction": ledger(f"""
SELECT txid, block_height, {coins('sat')} AS total_value, flow_type FROM txv WHERE txid = 'T7'""", TX_VIEW),
    "latest_block": ledger("""
SELECT height, min(block_time) AS time, CAST(count(*) AS INTEGER) AS tx_count FROM tx
GROUP BY height ORDER BY height DESC LIMIT 1"""),
    "tx_by_flow_type": ledger(f"""
SELECT txid, block_time, {coins('sat')} AS total_value FROM txv WHERE flow_type = 'transfer'""", TX_VIEW),
    "tx_top_buyers": tx_top("buy", "to", "total_bought"),
    "tx_top_sellers": tx_top("sell", "from", "total_sold"),
    "exchange_activity": ledger(f"""
SELECT address AS exchange_address, max(name) AS exchange_name,
       {coins("sum(CASE WHEN direction = 'to' AND flow_type = 'sell' THEN sat ELSE 0 END)")} AS total_inflow,
       {coins("sum(CASE WHEN direction = 'from' AND flow_type = 'buy' THEN sat ELSE 0 END)")} AS total_outflow,
       count(DISTINCT CASE WHEN direction = 'to' THEN txid END) AS sell_transactions,
       count(DISTINCT CASE WHEN direction = 'from' THEN txid END) AS buy_transactions
FROM txv JOIN cls USING (txid) WHERE type = 'exchange' AND flow_type IN ('buy', 'sell')
GROUP BY address""", TX_VIEW),
    "classification_counts": ledger(
        " SELECT type AS classification_type, count(*) AS parties FROM cls GROUP BY 1", TX_VIEW
    ),
    "tx_view_stats": ledger(f"""
SELECT (SELECT count(DISTINCT height) FROM tx) AS blocks, (SELECT min(height) FROM tx) AS min_height,
       (SELECT max(height) FROM tx) AS max_height, (SELECT count(*) FROM txv) AS transactions,
       (SELECT count(*) FROM cls) AS classifications,
       count(*) FILTER (WHERE flow_type = 'buy') AS buy_count,
       {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'buy'), 0)")} AS buy_value,
       count(*) FILTER (WHERE flow_type = 'sell') AS sell_count,
       {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'sell'), 0)")} AS sell_value,
       count(*) FILTER (WHERE flow_type = 'transfer') AS transfer_count,
       {coins("coalesce(sum(sat) FILTER (WHERE flow_type = 'transfer'), 0)")} AS transfer_value
FROM txv""", TX_VIEW),
    # files and streams
    "labels_from_files": ledger(" SELECT address, type, name FROM listed"),
    "registry_from_files": ledger(" SELECT address, node_count, tiers, total_collateral FROM ops"),
    "json_round_trip": ledger(f"SELECT txid, kind, height, vout, address, {coins('sat')} AS value FROM outp"),
    "stream_ingest": EVENTS,
    "stream_tip_and_backfill": EVENTS,
    "upsert_moved_key": ledger(" SELECT txid, height FROM tx"),
    "stream_flow_totals": ledger(f"""
SELECT flow_type, CAST(floor(block_height / 20160) AS BIGINT) AS height_bucket, {coins('sum(sat)')} AS total,
       count(*) AS events FROM ev GROUP BY 1, 2"""),
}

# The same answers over stored tables.
ORACLES |= {
    "flow_summary_stored": ORACLES["flow_summary_90d"],
    "net_flow_stored": ORACLES["net_flow_30d"],
    "top_buyers_stored": ORACLES["top_buyers_6m"],
    "attribution_report_maintained": ORACLES["attribution_report"],
    "flow_summary_rollup": ORACLES["flow_summary_90d"],
    "top_buyers_rollup": ORACLES["top_buyers_6m"],
    "lookup_stored": ledger("SELECT txid, vout, block_height, to_address, CAST(sat AS DOUBLE) / 1e8 AS amount FROM ev WHERE txid = 'T7'"),
    "tx_in_block": ledger(f"""
SELECT txid, block_height, {coins('sat')} AS total_value FROM txv WHERE block_height = (SELECT max(height) FROM tx)""", TX_VIEW),
    "blocks_from_files": ledger(f"SELECT txid, kind, height, vout, address, {coins('sat')} AS value FROM outp WHERE height % 2 = 0 OR kind = 'transfer'"),
    "details_round_trip": ledger("SELECT txid, vout, from_name, from_nodes, to_name, to_nodes FROM ev"),
    "stream_totals_maintained": ORACLES["stream_flow_totals"],
}

# Registries of two versions: before, one node each and some not yet there; after, some gone.
MACHINERY = "FROM customer WHERE c_mktsegment = 'MACHINERY'"
BEFORE = LEDGER.replace("unnest(range(1 + c_custkey % 3)) AS copy", "0 AS copy").replace(
    MACHINERY, f"{MACHINERY} AND c_custkey % 4 <> 1"
)
AFTER = LEDGER.replace(MACHINERY, f"{MACHINERY} AND c_custkey % 7 <> 0")
ORACLES |= {
    "stream_registry_refresh": f"""
SELECT * FROM (WITH {BEFORE} SELECT {EVENT_COLUMNS} FROM ev WHERE event_seq // 1048576 % 2 = 0)
UNION ALL
SELECT * FROM (WITH {AFTER} SELECT {EVENT_COLUMNS} FROM ev WHERE event_seq // 1048576 % 2 = 1)""",
    "relevance_from_ingest": ledger(
        """
SELECT 'block' AS part, height, relevant, total, relevant / total AS rate FROM rated
UNION ALL
SELECT 'batches', NULL, CAST(sum(relevant) AS BIGINT), CAST(sum(total) AS BIGINT), sum(relevant) / sum(total) FROM rated""",
        """
rated AS (
  SELECT height, coalesce(r.relevant, 0) AS relevant, n + CASE WHEN height % 4 = 0 THEN 0 ELSE height % 3 END AS total
  FROM (SELECT height, count(*) AS n FROM tx GROUP BY height)
  LEFT JOIN (SELECT block_height AS height, count(DISTINCT txid) AS relevant FROM ev GROUP BY 1) r USING (height))""",
    ),
}
