"""Structured Streaming: landed files -> validated upsert; ticks -> bars."""
