"""Planning on the driver: layouts and contractions."""
