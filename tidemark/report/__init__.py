"""Charts and reports: Spark prepares small tables, the driver renders them as text, SVG and HTML."""
