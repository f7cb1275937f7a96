"""Criteria, the ordered test plan, the qualification job and panel datasets."""
