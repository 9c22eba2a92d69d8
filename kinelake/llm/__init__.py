"""Corpus preparation operators for large text collections (subpackage on its own: nothing else imports it)."""
