"""Readers. Each returns accepted rows and, where a contract applies, the rejects."""
