"""cardlake: payment-fraud analytics expressed as Spark jobs."""
