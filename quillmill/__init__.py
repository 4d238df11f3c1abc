"""Text corpus curation and usage metering as Spark DataFrame operators."""
