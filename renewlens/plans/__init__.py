"""Wiring: feeds to typed tables to marts to named reports, and session settings."""
