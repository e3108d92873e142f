"""Part of inkspark."""
