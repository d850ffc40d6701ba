"""Readers of provider logs and writers of exports."""
