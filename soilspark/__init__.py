"""soilspark: soil water retention analytics as lazy Spark DataFrame plans."""
