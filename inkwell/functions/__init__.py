"""Part of inkwell."""
