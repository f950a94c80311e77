"""Sources and sinks of bars, universes and reports."""
