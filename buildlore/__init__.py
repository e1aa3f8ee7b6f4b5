"""Build-order analytics over many source repositories, as Spark DataFrame operators."""
