"""Record linkage and corpus preparation on Apache Spark."""
