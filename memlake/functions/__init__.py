"""Part of memlake."""
