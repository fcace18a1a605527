"""panelcast: entity-period risk analytics as Spark DataFrame jobs."""
