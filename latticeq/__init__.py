"""latticeq: similarity analytics over sequences, structures and embeddings on Spark."""
