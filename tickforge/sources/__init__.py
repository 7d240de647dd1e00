"""Sources (scans of bar files and of the test tables) and sinks."""
