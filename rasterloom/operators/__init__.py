"""Operators over frames and opcode streams."""
