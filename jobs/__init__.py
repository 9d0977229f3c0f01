"""Jobs that are run from the command line: a map of trust over a table, and an audit of records as they arrive."""
