"""Work-hours analytics on Spark: file triage, entry building, validation, payroll and reports."""
