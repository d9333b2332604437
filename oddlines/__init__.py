"""oddlines: unsupervised log-anomaly analytics as Spark jobs."""
