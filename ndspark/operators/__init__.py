"""Array operators, grouped as mixins of ``ndspark.array.NDArray``."""
