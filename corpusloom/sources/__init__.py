"""Sources and sinks of corpora, vectors and pending requests."""
