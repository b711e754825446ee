"""Every operator as a query over the test tables, and the same query as plain SQL."""
