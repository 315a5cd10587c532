"""The counting plan over streams."""
