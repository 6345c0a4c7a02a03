"""DataFrame -> DataFrame operators; every one takes its key columns as a parameter."""
