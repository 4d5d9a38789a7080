"""Detection, resolution, naming, masking, restoring, reporting and auditing."""
