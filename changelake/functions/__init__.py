"""Column and schema functions without I/O."""
