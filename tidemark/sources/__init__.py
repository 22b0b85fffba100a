"""Sources and sinks: the retail star schema, delimited and JSON files."""
