"""monthloom: panel forecasting, change detection and corpus preparation on Apache Spark."""
