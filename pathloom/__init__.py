"""Path queries over collections of JSON documents on Spark."""
