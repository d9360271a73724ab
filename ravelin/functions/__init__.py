"""See the package docstring of ravelin."""
