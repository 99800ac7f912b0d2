"""Part of the skymatch engine; see the README."""
