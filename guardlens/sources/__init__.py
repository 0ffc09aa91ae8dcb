"""Readers and writers for traces, state dumps, timelines, logs and result tables."""
