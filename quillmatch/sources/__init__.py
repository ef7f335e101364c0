"""Sources and sinks: files, the pattern index, stored tf-idf models."""
