"""Compositions: landing views of the test tables, and the read queries."""
