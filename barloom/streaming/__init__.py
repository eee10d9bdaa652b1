"""Bars as they come: files loaded once, corrections, indicators from bounded state."""
