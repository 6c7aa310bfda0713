"""rowworth: how much is each labelled row worth, computed as Spark jobs."""
