"""Code-change analytics and text-range algebra as Spark DataFrame operators."""
