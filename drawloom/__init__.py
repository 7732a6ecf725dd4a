"""drawloom: a Spark-first analytics engine for long ordered integer series and the tables around them."""
