"""Sinks. A sink is any callable ``(DataFrame, kind) -> None``; register new ones in ``tables.BACKENDS``."""
