"""plyweave: alignment of families of variants, presence matrices and feature traces on Spark."""
