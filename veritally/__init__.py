"""Spark jobs that evaluate image detectors: catalogue, tasks, replies, roll-ups, metrics, ablations, labelling."""
