"""Capture: tailing session files, turns from their records, and exactly-once rows of the ledger."""
