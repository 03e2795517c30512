"""Rule configuration, the rule engine and the query catalogue."""
