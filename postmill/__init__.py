"""Mail corpus preparation and analytics as Spark DataFrame operators."""
