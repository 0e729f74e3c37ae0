"""Sources and sinks: state, version log, versioned tables, JSON and file trees."""
