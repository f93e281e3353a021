"""Readers and writers: image and ground-truth folders, recorded payloads, run logs."""
