"""Quern: behaviour and document analytics expressed as Spark DataFrame plans."""
