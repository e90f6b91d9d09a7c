"""citeloom: bibliographic verification and corpus preparation as Spark DataFrame plans."""
