"""Closed bars from a stream of ticks."""
