"""Sources and sinks: file-backed adapters, data sources, outboxes."""
