"""What order books should show, from the definition: sizes by price, sorted when looked at."""


def snapshots(events):
    """``events``: dicts of one channel in seq order. Yields (seq, ts, bids, asks) as lists of pairs."""
    sizes, batch = {}, None  # (side, price) -> size; the changes of an open batch
    for e in events:
        mark = e["update_type"] if e["kind"] == "QUOTE" else e["kind"]
        quoted = [((e["side"], e["price"]), e["size"] if e["size_flag"] else 0)] if e["price_flag"] else []
        listed = [((s, x["price"]), x["size"]) for s in ("bid", "ask") for x in e[f"{s}_levels"] or []]
        apply = []
        if mark in ("IMAGE", "CLEAR"):
            sizes = {}
        if mark == "CLEAR" or mark == "BEGIN":
            batch = None
        if mark in ("BEGIN", "MIDDLE", "END"):
            batch = (batch or []) + quoted
        if mark in ("IMAGE", "UPDATE", "HISTORY"):
            apply = [c for c in listed if mark != "IMAGE" or c[1]]
        elif mark == "SOLO":
            apply = quoted
        elif mark in ("END", "END_QUOTE"):
            if batch is None:
                continue
            apply, batch = batch, None
        elif mark != "CLEAR":
            continue
        sizes |= dict(apply)
        sizes = {k: v for k, v in sizes.items() if v}
        if e["exchange_ts"] or sizes:
            bids = sorted(((p, float(q)) for (s, p), q in sizes.items() if s == "bid"), reverse=True)
            asks = sorted((p, float(q)) for (s, p), q in sizes.items() if s == "ask")
            yield e["seq"], e["exchange_ts"] or e["recv_us"], bids, asks
