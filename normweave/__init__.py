"""Policy analytics and text preparation as Spark jobs."""
