"""The registered queries: library operators over views of the given tables, and their SQL."""
