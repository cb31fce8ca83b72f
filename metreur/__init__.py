"""Bills of quantities from construction specifications, as Spark jobs."""
