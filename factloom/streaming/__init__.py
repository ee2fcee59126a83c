"""Beyond the method: keeping a graph up to date from a stream of documents."""
