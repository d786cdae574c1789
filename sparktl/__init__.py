"""sparktl: temporal-logic analytics as Spark DataFrame plans."""
