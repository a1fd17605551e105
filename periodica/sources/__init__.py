"""Bars from ticks, files and provider payloads."""
