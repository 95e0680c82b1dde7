"""flowsift: network-flow threat analytics expressed as Spark DataFrame jobs."""
