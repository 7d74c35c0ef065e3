"""Readers and writers for the files a monitoring system leaves behind."""
