"""The analyses: study domains, regimens, outcomes, the pooled cohort and its reports."""
