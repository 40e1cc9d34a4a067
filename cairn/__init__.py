"""cairn: spatial, mobility and place-data operators as PySpark DataFrame plans."""
