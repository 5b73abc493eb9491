"""foretrace: history analytics over entity events, as Spark DataFrame operators."""
