"""A plain, wallet-at-a-time walk over a small ledger, to test attribution against."""

from collections import defaultdict

WINDOW = 87600


class Walk:
    def __init__(self, inputs, outputs, operators):
        """``inputs`` and ``outputs``: (txid, kind, height, time, index, pos, address)."""
        self.operators = set(operators)
        self.vin, self.vout, tx = defaultdict(list), defaultdict(list), {}
        for side, rows in ((self.vin, inputs), (self.vout, outputs)):
            for txid, kind, height, time, index, pos, address in rows:
                tx[txid] = (kind, height, time, index)
                side[txid].append((pos, address))
        for side in (self.vin, self.vout):
            for txid in side:
                side[txid] = [a for _, a in sorted(side[txid])]
        self.history = defaultdict(dict)
        for txid, (kind, height, time, index) in tx.items():
            if kind == "confirm":
                continue
            for a in self.vout[txid]:
                self.history[a][txid] = (height, index, time, "received", kind == "coinbase")
            for a in self.vin[txid]:
                self.history[a][txid] = (height, index, time, "sent", False)

    def newest_first(self, wallet):
        return sorted(((*v, k) for k, v in self.history[wallet].items()), reverse=True)

    def coinbase(self, wallet, height):
        hits = [r[0] for r in self.newest_first(wallet) if r[4] and height - WINDOW <= r[0] <= height]
        return (len(hits), hits[0], (height - hits[0]) * 30 // 86400) if hits else None

    def connection(self, wallet, height, side):
        direction = "sent" if side == "buying" else "received"
        found = [
            r for r in self.newest_first(wallet)
            if r[3] == direction and not r[4] and height - WINDOW <= r[0] <= height
        ]
        checked = set()
        for row in found:
            for other in self.vout[row[5]] if side == "buying" else self.vin[row[5]]:
                if other in checked:
                    continue
                checked.add(other)
                if other in self.operators:
                    return ("active", other, row[5], row[0], None)
                proof = self.coinbase(other, height)
                if proof:
                    return ("historical", other, row[5], row[0], proof[0])
        return None

    def hop(self, wallet, height, time, side):
        for h, _, t, direction, _, txid in self.newest_first(wallet):
            if side == "buying" and not (h > height and t > time and direction == "sent"):
                continue
            if side == "selling" and not (h < height and t < time and direction == "received"):
                continue
            for other in self.vout[txid] if side == "buying" else self.vin[txid]:
                if other != wallet:
                    return other, txid
        return None

    def resolve(self, wallet, height, time, side, depth=2):
        """(method, status, level, node, chain, txids, count, cycle)"""
        proof = self.coinbase(wallet, height)
        if proof:
            return ("historical_coinbase", "historical", 0, wallet, None, None, proof[0], False)
        link = self.connection(wallet, height, side)
        if link:
            return ("historical_connection", link[0], 0, link[1], None, link[2], link[4], False)
        visited, chain, txids, current = {wallet}, [], [], wallet
        for level in range(1, depth + 1):
            step = self.hop(current, height, time, side)
            if step is None:
                break
            other, txid = step
            if other in visited:
                return (None, None, None, None, None, None, None, True)
            chain, txids = chain + [current], txids + [txid]
            if other in self.operators:
                return ("current_api", "active", level, other, ",".join(chain), ",".join(txids), None, False)
            proof = self.coinbase(other, height)
            if proof:
                return (
                    "historical_coinbase", "historical", level, other, ",".join(chain), ",".join(txids),
                    proof[0], False,
                )
            visited.add(other)
            current = other
        return (None, None, None, None, None, None, None, False)
