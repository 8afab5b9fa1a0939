"""Column functions: detection, checksums, codecs and formats."""
