"""Sources and sinks: tables, replicas, generated data, key-value stores, files and sketches."""
