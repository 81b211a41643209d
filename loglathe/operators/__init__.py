"""The template miners and the template-line matching operators."""
