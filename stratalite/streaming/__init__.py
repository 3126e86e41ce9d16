"""Structured streams: tables that grow by files, statistics that run along, windows of time."""
