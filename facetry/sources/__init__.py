"""Feature tables: readers, builders, planted data, noise and sinks."""
