"""Sources and sinks: the init.dat text format, raw page files, and file-system helpers."""
