"""Registered queries: each pairs a DataFrame plan with SQL that must give the same rows."""
