"""Training-data operators. Nothing outside this subpackage imports it, but for the guarded import of ``__spark_entry__``."""
