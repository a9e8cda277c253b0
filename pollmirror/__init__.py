"""Survey-parity analytics as Spark jobs: every operator is DataFrame -> DataFrame."""
