"""Paths that several test modules use."""

SF_SMALL = "/root/testdata/sf0.001"
