"""Bibliographic metadata from positioned-word page layouts, in batch over many documents."""
