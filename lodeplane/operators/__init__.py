"""DataFrame -> DataFrame operators; lazy, no driver-side collection."""
