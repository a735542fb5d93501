"""DataFrame operators grouped by SURVEY §2 section."""
