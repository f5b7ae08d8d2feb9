"""casebraid: case-event analytics as Spark DataFrame transformations."""
