"""Part of the weirflow package."""
