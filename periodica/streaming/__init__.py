"""Bars from streams of ticks."""
