"""Views over the test tables, and the queries that are run on them."""
