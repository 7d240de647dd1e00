"""DataFrame -> DataFrame operators over bar tables."""
