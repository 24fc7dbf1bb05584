"""quantloom: an equity research engine whose every operator is a Spark job."""
