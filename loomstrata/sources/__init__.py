"""Sources and sinks: repository trees, JSON documents, result tables, text providers."""
