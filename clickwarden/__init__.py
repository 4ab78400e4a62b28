"""Web-log sessions, navigation features and early bot detection as Spark jobs."""
