"""Readers and writers: labelled CSV, archives, scan feeds, URL lists,
dictionaries, reports, registry and model artefacts."""
