"""One order book as state of a stream; Spark decides which events reach it and in what order."""

from __future__ import annotations

from bisect import bisect_left, insort

EVENT_COLUMNS = (
    "channel_id", "seq", "exchange_ts", "recv_us", "kind", "side", "update_type",
    "price_flag", "size_flag", "price", "size", "bid_levels", "ask_levels",
)
SIDES = ("bid", "ask")


class Book:
    """Size by price for each side, its prices in order, and the batch being buffered. Sides have no limit."""

    __slots__ = ("sides", "prices", "pending", "active")

    def __init__(self, levels=(), pending=(), active: bool = False):
        """``levels`` and ``pending`` changes are (side, price, size)."""
        self._reset()
        for side, price, size in levels:
            self.sides[side][price] = size
        self.prices = {name: sorted(own) for name, own in self.sides.items()}
        self.pending, self.active = list(pending), bool(active)

    def levels(self) -> dict[tuple[str, float], float]:
        return {(side, price): size for side, own in self.sides.items() for price, size in own.items()}

    def shown(self, depth: int | None = None) -> list[list[float]]:
        """Bid prices and sizes, ask prices and sizes; best level first."""
        out = []
        for name in SIDES:
            own = self.prices[name]
            n = len(own) if depth is None else min(depth, len(own))
            best = own[len(own) - n :][::-1] if name == "bid" else own[:n]
            out += [best, [self.sides[name][p] for p in best]]
        return out

    def put(self, changes) -> None:
        for side, price, size in changes:
            own, order = self.sides[side], self.prices[side]
            if size and size > 0:
                if price not in own:
                    insort(order, price)
                own[price] = float(size)
            elif price in own:
                del own[price], order[bisect_left(order, price)]

    def _reset(self) -> None:
        self.sides = {name: {} for name in SIDES}
        self.prices = {name: [] for name in SIDES}

    def step(self, kind, side, update_type, price_flag, size_flag, price, size, bid_levels, ask_levels) -> bool:
        """Apply one event; True when a snapshot is due."""
        if kind in ("IMAGE", "UPDATE", "HISTORY"):
            if kind == "IMAGE":
                self._reset()
            for name, levels in zip(SIDES, (bid_levels, ask_levels)):
                found = [(name, x["price"], x["size"]) for x in levels if x] if levels is not None else []
                self.put(c for c in found if kind != "IMAGE" or (c[2] and c[2] > 0))
            return True
        if kind == "QUOTE":
            return self._quote(update_type, [(side, price, size if size_flag else 0)] if price_flag else [])
        due = kind == "END_QUOTE" and self.active
        if due:
            self._commit()
        return due

    def _quote(self, update_type: str, change: list) -> bool:
        if update_type == "SOLO":
            self.put(change)
        elif update_type == "CLEAR":
            self._reset()
            self.pending, self.active = [], False
        elif update_type in ("BEGIN", "MIDDLE", "END"):
            if update_type == "BEGIN" or not self.active:
                self.pending, self.active = [], True
            self.pending += change
            if update_type == "END":
                self._commit()
        return update_type in ("SOLO", "CLEAR", "END")

    def _commit(self) -> None:
        self.put(self.pending)
        self.pending, self.active = [], False

    def snapshot_time(self, exchange_ts: int | None, recv_us: int) -> int | None:
        """The event's time; for a zero time the receive time, or None when there is nothing to show."""
        return exchange_ts or (recv_us if any(self.sides.values()) else None)
