"""loam: document corpora, retrieval and answer evaluation as Spark jobs."""
