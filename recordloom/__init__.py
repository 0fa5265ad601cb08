"""recordloom: schema-validated, versioned record collections as Spark DataFrame plans."""
