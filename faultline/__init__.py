"""Fleet log and metric incident analytics, written as Spark DataFrame transformations."""
