"""corpusq: analytics over document corpora and question logs, as Spark jobs."""
