"""Spark jobs for dated people directories: extraction, identity, comparison, search, exports, upkeep."""
