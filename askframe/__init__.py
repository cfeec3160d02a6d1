"""Questions over JSON records and typed tables, planned by Spark."""
