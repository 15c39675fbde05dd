"""Sources and sinks: CSV with header modes, and base64 text."""
