"""Relational operators over evidence, artefacts, assessments and scans."""
