"""Risk analytics over incident reports, as DataFrame operators."""
