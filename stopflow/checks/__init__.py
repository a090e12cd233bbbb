"""The operators as named queries on the test tables, each with an independent SQL twin."""
