"""Sources and sinks: archives, page text, per-year JSON, CSV and serving documents."""
