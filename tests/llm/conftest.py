"""Documents, and sorted rows."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text, source, lang), with a column whose name may clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else None, 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, id int")

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded words without meaning."""

    def make(seed, n, syllables="ba de ki lo mu na po ri su te vo za".split()):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make
