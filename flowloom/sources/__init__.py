"""Scans of raw logs and packet tables, and table stores."""
