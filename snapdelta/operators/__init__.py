"""DataFrame operators: components, change detection and versions."""
