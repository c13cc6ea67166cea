"""Analytics over stacks of aligned images, written as Spark DataFrame jobs."""
