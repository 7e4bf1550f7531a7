"""DataFrame -> DataFrame operators over records and cells."""
