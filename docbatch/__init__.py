"""docbatch: rule-driven analytics over large document collections, written as Spark plans."""
