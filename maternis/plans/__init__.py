"""End-to-end plans: classification, marts, merge/refresh, reports."""
