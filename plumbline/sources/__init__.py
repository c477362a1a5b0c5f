"""Readers and writers of frames, shards, queues, logs and telemetry."""
