"""weir: durable work queues and shared immutable artifacts as queries over Spark tables."""
