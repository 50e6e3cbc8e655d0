"""Sources and sinks: catalogue files, configuration, vectors, audio."""
