"""Sources and sinks: archive logs, CSV tables, graph files and stored objects."""
