"""Reading comparison and corpus preparation on Spark."""
