"""Reading traces: file formats, time columns and validation."""
