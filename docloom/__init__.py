"""docloom: schema-first document analytics on PySpark."""
