"""DataFrame operators over the reports table."""
