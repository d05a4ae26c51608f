"""Reading and writing trajectories, shards, manifests and run logs."""
