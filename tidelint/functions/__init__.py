"""Column expressions: flags, seawater, solar geometry, label parsing."""
