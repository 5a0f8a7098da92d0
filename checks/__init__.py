"""Registered queries, the test data they run on, and the SQL they must equal."""
