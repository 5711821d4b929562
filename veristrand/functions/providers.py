"""Provider subjects and the public address each one stands for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four providers, the shape of their subjects, and the address of a subject.
PROVIDERS = {
    "openalex-author": (r"^A\d+$", "https://api.openalex.org/authors/", ""),
    "openalex-institution": (r"^I\d+$", "https://api.openalex.org/institutions/", ""),
    "github-profile": (r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$", "https://api.github.com/users/", ""),
    "github-repos": (r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$", "https://api.github.com/users/",
                     "/repos?type=owner&sort=pushed&per_page=100"),
}


def endpoint(provider: Column, subject: Column) -> Column:
    """NULL when the provider is unknown or the subject has the wrong shape."""
    result = F.lit(None).cast("string")
    for name, (shape, prefix, suffix) in PROVIDERS.items():
        result = F.when((provider == name) & subject.rlike(shape),
                        F.concat(F.lit(prefix), subject, F.lit(suffix))).otherwise(result)
    return result


def check_subject(provider: str, subject: str) -> None:
    if provider not in PROVIDERS or not re.match(PROVIDERS[provider][0], subject):
        raise ValueError("Unsupported provider or identifier")
