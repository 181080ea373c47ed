"""Readers and writers of documents, mail, lists and reports."""
