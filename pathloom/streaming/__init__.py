"""Path queries over streams of documents."""
