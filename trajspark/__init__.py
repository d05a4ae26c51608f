"""trajspark: prepare, pair, score and evaluate large collections of trajectories on Spark."""
