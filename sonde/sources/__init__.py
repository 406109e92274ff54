"""Sources and sinks: file walk, chunk store, model files, result formats."""
