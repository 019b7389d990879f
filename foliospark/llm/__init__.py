"""Operators for text corpora: encoding, packing, sentences, and variant names. Nothing else imports this subpackage."""
