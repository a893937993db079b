"""Operators on volumes in voxel form: a row a voxel, (z, y, x, value) or (z, y, x, label)."""
