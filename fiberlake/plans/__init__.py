"""End-to-end plans and the catalogue of queries over the driver's tables."""
